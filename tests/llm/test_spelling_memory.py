"""Nothing that grows with the vocabulary is gathered in the driver."""

from dealtide.llm import spelling
from dealtide.llm.common import settled

from .conftest import table


def test_tables_made_of_the_vocabulary_are_not_broadcast(spark):
    """Stored words are small in bytes, also when each gives a row per prefix, direction, key and part."""
    words = settled(table(spark, [(f"word{a}{b}en", 5) for a in "abcdefgh" for b in "ijklmnop"], "word string, n long"))
    plan = lambda frame: frame._jdf.queryExecution().executedPlan().toString()
    edges = settled(spelling.trie(words))
    states = edges.selectExpr("false back", "label word", "0 pos", "x", "y", "fan", "0 edits")
    for frame in (spelling.trie(words), spelling.advanced(states, edges.filter("level = 0"))):
        assert "SortMergeJoin" in plan(frame) and "Broadcast" not in plan(frame)
