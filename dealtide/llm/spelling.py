"""Spelling variant grouping by a relational trie frontier.

The vocabulary is a path-compressed trie, held as a distributed table of edges: from a node, by a label of one or
more letters, to the node below. A node is a prefix, named by two 64-bit hashes; only the root, words, and prefixes that branch are nodes.
States (word, pos, node, edits) say how far a word is spelled along a path. All start at the root without edits; each round joins the
states with the edges of its level: the word's own edge goes on without an edit, any other edge may take the one edit at its
first letter (replaced, inserted or deleted), and after it labels must agree. Edges are keyed by their first and by their second letter, and
a state asks by the letter that its step needs there, so hardly any edge is met in vain. A state goes on only if the node below has
an edge for the word's next letter. States that end a word at the end of another, with one edit made, are its neighbours.

Near the root most edges would be tried for every word. So words stand in the trie forwards and backwards, and an edit is made only
in the second half of the way: two words that part in the first half agree in the other one, and meet on the way back.
Two words part at exactly one node of a direction, and their lengths tell which edit it is, so each neighbour is found once.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..streaming.folders import remove
from .common import documents, settled, shared
from .registry import query

#: Letters of a word at least, occurrences at least, how many times as frequent a form is, and which remainder loses a letter.
SHORTEST, LEAST, RATIO, DROPPED = 6, 5, 5, 199
#: Words a task takes at one node; the edges of a node with more are repeated for each such part.
WIDE = 20_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
STATE = "back boolean, word string, pos int, x long, y long, fan int, edits int, near string, near_n long, found boolean"


def vocabulary(docs: DataFrame, shortest: int = SHORTEST, least: int = LEAST, dropped: int = DROPPED) -> DataFrame:
    """(word, n) of ``docs`` (doc_id, text): runs of letters in lower case, a letter lost where the hash of document and run says so.

    A null doc_id counts as an empty one. Occurrences are counted in each partition first.
    """
    # a run loses one letter at most, so shorter ones cannot become words; a match from the left takes a run whole
    runs = F.regexp_extract_all("text", F.lit(f"[A-Za-z\\u00C0-\\u00FF]{{{shortest},}}+"), F.lit(0))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    plain = F.octet_length("run") == F.char_length("run")
    rows = rows.withColumn("run", F.when(plain, F.lower("run")).otherwise(F.translate("run", UPPER, LOWER)))
    rows = rows.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.char_length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    words = rows.select(F.when(F.col("h") % dropped == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).filter((F.col("n") >= least) & (F.char_length("word") >= shortest))


def merged(side: DataFrame) -> DataFrame:
    """``side`` of a join that is not to be broadcast.

    Spark takes the size of a stored table's files, in which words of one trie lie close together, and counts what is exploded from a row as one row. Tables made
    of the vocabulary seemed small to it, were gathered in the driver and filled its memory.
    """
    return side.hint("merge")


def name_of(back: Column, prefix: Column) -> list[Column]:
    return [F.xxhash64(F.lit(n), back, prefix).alias(name) for n, name in enumerate("xy")]


def turned(word: Column, back: Column) -> Column:
    return F.when(back, F.reverse(word)).otherwise(word)


def half(word: Column, back: Column) -> Column:
    """The letters of a word, as it stands in the trie, that come before its edit: both directions together leave no place out."""
    size = F.char_length(word)
    return F.when(back, size - F.floor(size / 2)).otherwise(F.floor(size / 2)).cast("int")


def letter_bits(letter: Column) -> tuple[Column, Column]:
    """A letter as a bit of two numbers: a-z, and U+00C0 to U+00FF."""
    code = F.ascii(letter)
    bit = lambda first: F.call_function("shiftleft", F.lit(1).cast("long"), code - first)
    return F.when((letter != "") & (code < 128), bit(97)), F.when(code > 191, bit(192))


def among(letter: Column, low: Column, high: Column) -> Column:
    code = F.ascii(letter)
    return F.when(code < 128, F.getbit(low, code - 97)).otherwise(F.getbit(high, code - 192)) == 1


def trie(words: DataFrame, wide: int = WIDE) -> DataFrame:
    """The edges of the trie of ``words`` (word, n) in both directions: (level, x, y, fan, label, cx, cy, ends, ends_n, low, high, cfan).

    ``level`` counts the edges from the root to (x, y); ``ends`` is the word, as it stands in the trie, that ends below the label, if
    one does, ``low`` and ``high`` the first letters of the edges below as bits. ``fan`` tells into how many parts the words at a node
    are dealt. A word has a row for every prefix, so the work grows with the square of a word's length.
    """
    both = words.select(F.explode(F.array(F.lit(False), F.lit(True))).alias("back"), "word", "n").withColumn("word", turned(F.col("word"), F.col("back")))
    at = both.select("back", "word", "n", F.explode(F.sequence(F.lit(0), F.char_length("word"))).alias("depth"))
    path = at.select("back", "word", "n", "depth", *name_of(F.col("back"), F.substring("word", F.lit(1), F.col("depth"))), F.substring("word", F.col("depth") + 1, F.lit(1)).alias("letter"))
    low, high = letter_bits(F.col("letter"))
    # all words pass the root: it is no node to look up
    nodes = path.filter("depth > 0").groupBy("x", "y").agg(
        F.coalesce(F.bit_or(low), F.lit(0).cast("long")).alias("low"), F.coalesce(F.bit_or(high), F.lit(0).cast("long")).alias("high"),
        F.count("*").alias("passing"), F.max(F.when(F.col("letter") == "", F.col("n"))).alias("end_n"),
    )
    nodes = nodes.filter((F.bit_count("low") + F.bit_count("high") > 1) | F.col("end_n").isNotNull())
    nodes = nodes.select("x", "y", "low", "high", "end_n", F.ceil(F.col("passing") / wide).cast("int").alias("fan"))
    fan = F.lit(parts(words, wide))
    root = both.select("back", "word", F.lit(0).alias("depth"), *name_of(F.col("back"), F.lit("")), *[F.lit(None).cast("long").alias(c) for c in ("low", "high", "end_n")], fan.alias("fan"))
    # a one-letter prefix may hold a third of all words: a skewed join is dealt anew by the engine
    steps = path.filter("depth > 0").select("back", "word", "depth", "x", "y").join(merged(nodes), ["x", "y"]).select(root.columns).unionAll(root)
    order = Window.partitionBy("back", "word").orderBy("depth")
    below = F.lead(F.struct("depth", "x", "y", "low", "high", "end_n", "fan")).over(order)
    steps = steps.withColumn("level", F.row_number().over(order) - 1).withColumn("below", below).filter("below IS NOT NULL")
    label = F.substring("word", F.col("depth") + 1, F.col("below.depth") - F.col("depth"))
    ends = F.when(F.col("below.end_n").isNotNull(), F.substring("word", F.lit(1), F.col("below.depth")))
    # the edge of a node by a letter is one, so all its rows agree
    steps = steps.select("level", "x", "y", "fan", label.alias("label"), ends.alias("ends"), *[F.col(f"below.{c}").alias(name) for c, name in BELOW.items()])
    return steps.groupBy("level", "x", "y", "label", "ends").agg(F.max("fan").alias("fan"), *[F.max(name).alias(name) for name in BELOW.values()])


BELOW = {"x": "cx", "y": "cy", "low": "low", "high": "high", "end_n": "ends_n", "fan": "cfan"}


def parts(words: DataFrame, wide: int) -> int:
    """Into how many parts the words at the root are dealt."""
    return max(1, -(-words.count() // wide))


def keyed_edges(edges: DataFrame) -> DataFrame:
    """``edges`` under each key by which a state finds them: the first letter of a way down from the node, and the second one.

    The second letters of a label of one letter are those of the edges below it, and none if a word ends there.
    """
    letters = F.array(*[F.lit(chr(c)) for c in (*range(97, 123), *range(192, 256))])
    below = F.filter(letters, lambda c, n: F.when(n < 26, F.getbit(F.col("low"), n)).otherwise(F.getbit(F.col("high"), n - 26)) == 1)
    end = F.when(F.col("ends").isNotNull(), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    second = F.when(F.char_length("label") > 1, F.array(F.substring("label", 2, 1))).otherwise(F.concat(below, end))
    keys = F.concat(F.array(F.concat(F.lit("1"), F.substring("label", 1, 1))), F.transform(second, lambda c: F.concat(F.lit("2"), c)))
    return edges.withColumn("key", F.explode(keys)).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("fan") - 1))).drop("fan", "level")


#: What a state does along an edge.
OWN, REPLACE, INSERT, DELETE = range(4)


def keyed_states(states: DataFrame) -> DataFrame:
    """``states`` with each step that they may try and the key of the edges it needs.

    After a replaced letter the word's next letter comes second on the way down, after an inserted one its present letter does; a
    deleted one makes the next letter the first.
    """
    word, pos = F.col("word"), F.col("pos")
    left = F.char_length(word) - pos
    this, following = F.substring(word, pos + 1, F.lit(1)), F.substring(word, pos + 2, F.lit(1))
    may = (F.col("edits") == 0) & (pos >= half(word, F.col("back")))
    step = lambda can, way, place, letter: F.when(can, F.struct(F.lit(way).alias("way"), F.concat(F.lit(place), letter).alias("key")))
    steps = [step(left > 0, OWN, "1", this), step(may & (left > 0), REPLACE, "2", following), step(may, INSERT, "2", this), step(may & (left > 1) & (this != following), DELETE, "1", following)]
    return states.withColumn("part", F.pmod(F.xxhash64("word"), F.col("fan")).cast("int")).drop("fan").withColumn("_step", F.explode(F.array_compact(F.array(*steps)))).select(
        *[c for c in states.columns if c != "fan"], "part", "_step.way", "_step.key",
    )


def advanced(states: DataFrame, edges: DataFrame) -> DataFrame:
    """What ``states`` become along ``edges`` of their level: states that go on, and (back, word, near, near_n) marked ``found``."""
    word, pos, way, label = F.col("word"), F.col("pos"), F.col("way"), F.col("label")
    # letters of the word, from which place on, that must stand in the label, from which place on
    ahead = F.when(way == INSERT, F.lit(0)).when(way == OWN, F.lit(0)).otherwise(F.lit(1))
    given = F.when(way.isin(REPLACE, INSERT), F.substring(label, 2, 1 << 30)).otherwise(label)
    fits = F.startswith(F.substring(word, pos + ahead + 1, F.char_length(label)), given) & ((way == OWN) | (F.substring(label, 1, 1) != F.substring(word, pos + 1, F.lit(1))))
    pairs = keyed_states(states).join(merged(keyed_edges(edges)), ["x", "y", "part", "key"]).filter(fits)
    to = pos + F.char_length(label) + F.when(way == INSERT, F.lit(-1)).when(way == DELETE, F.lit(1)).otherwise(F.lit(0))
    moved = pairs.select("back", "word", to.alias("pos"), "cx", "cy", "cfan", "low", "high", "ends", "ends_n", F.when(way == OWN, F.col("edits")).otherwise(F.lit(1)).alias("edits"))
    after, edits = F.char_length("word") - F.col("pos"), F.col("edits")
    next_fits = (after > 0) & among(F.substring(word, F.col("pos") + 1, F.lit(1)), F.col("low"), F.col("high"))
    on = F.when(edits == 0, F.col("low").bitwiseOR(F.col("high")) != 0).otherwise(next_fits)
    # one edit made and both at their end; or none, and the word has one letter more
    ended = F.col("ends").isNotNull() & (after + edits == 1)
    void = F.lit(None)
    state = [F.col(c).alias(name) for c, name in (("pos", "pos"), ("cx", "x"), ("cy", "y"), ("cfan", "fan"), ("edits", "edits"))]
    end = [void.cast(kind).alias(name) for name, kind in (("pos", "int"), ("x", "long"), ("y", "long"), ("fan", "int"), ("edits", "int"))]
    made = F.array_compact(F.array(
        F.when(on, F.struct(*state, void.cast("string").alias("near"), void.cast("long").alias("near_n"), F.lit(False).alias("found"))),
        F.when(ended, F.struct(*end, F.col("ends").alias("near"), F.col("ends_n").alias("near_n"), F.lit(True).alias("found"))),
    ))
    return moved.filter(on | ended).select("back", "word", F.explode(made).alias("s")).select("back", "word", "s.*")


def neighbours(words: DataFrame, wide: int = WIDE) -> DataFrame:
    """(word, near, near_n): of each of ``words`` (word, n) all others that differ by one letter, each once.

    Rounds go on until no state is left, as many as a path has edges. A round's states are removed when the next round is written.
    """
    spark = words.sparkSession
    edges = settled(trie(words, wide))
    both = words.select(F.explode(F.array(F.lit(False), F.lit(True))).alias("back"), "word")
    states = both.select("back", turned(F.col("word"), F.col("back")).alias("word"), F.lit(0).alias("pos"), *name_of(F.col("back"), F.lit("")), F.lit(parts(words, wide)).alias("fan"), F.lit(0).alias("edits"))
    folder, level = f"{shared(spark)}/llm/{uuid.uuid4().hex}", 0
    schema = T.StructType.fromDDL(STATE)
    while True:
        advanced(states, edges.filter(F.col("level") == level)).write.partitionBy("found").parquet(f"{folder}/level={level}")
        if level:
            remove(spark, f"{folder}/level={level - 1}/found=false")
        made = spark.read.schema(schema).parquet(f"{folder}/level={level}")
        states = made.filter("NOT found").drop("near", "near_n", "found")
        if states.isEmpty():
            break
        level += 1
    found = spark.read.schema(T.StructType([*schema.fields, T.StructField("level", T.IntegerType())])).parquet(folder)
    found = found.filter("found").select("back", *[turned(F.col(c), F.col("back")).alias(c) for c in ("word", "near")], "near_n")
    # what goes on beyond the first half alike has been found forwards
    first = lambda c: F.substring(c, F.lit(1), half(F.col("word"), F.lit(False)))
    return found.filter(~F.col("back") | (first("word") != first("near"))).select("word", "near", "near_n")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of ``forms`` (word, form): the last of the forms that follow. Each round doubles the way gone."""
    now = settled(forms.select("word", F.col("form").alias("root")))
    while True:
        on = now.select(F.col("word").alias("_at"), F.col("root").alias("_on"))
        now = settled(now.join(merged(on), now["root"] == on["_at"], "left").select("word", F.coalesce("_on", "root").alias("root"), F.col("_on").isNotNull().alias("moved")))
        moved = not now.filter("moved").isEmpty()
        now = now.select("word", "root")
        if not moved:
            return now


def grouped(docs: DataFrame, shortest: int = SHORTEST, least: int = LEAST, ratio: int = RATIO, dropped: int = DROPPED, wide: int = WIDE) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of ``docs`` (doc_id, text).

    ``form`` is the most frequent neighbour (ties: the least), if it is ``ratio`` times as frequent as the word; ``root`` follows
    forms to the last. Null and empty texts have no words, repeated rows count each, other columns are left out.
    """
    words = settled(vocabulary(docs, shortest, least, dropped))
    near = neighbours(words, wide).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    near = near.select("word", "n_near", F.col("best.near").alias("near"), (-F.col("best.less")).alias("near_n"))
    rows = words.join(merged(near), "word", "left")
    far = F.col("near_n") >= ratio * F.col("n")
    rows = settled(rows.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(far, F.col("near")).alias("form"), F.when(far, F.col("near_n")).alias("form_n")))
    last = roots(rows.filter("form IS NOT NULL"))
    return rows.join(merged(last), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


SQL = r"""
WITH RECURSIVE runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents
),
once AS (SELECT coalesce(doc_id::VARCHAR, '') || ':' || run AS named, run, count(*) AS n FROM runs GROUP BY ALL),
crc AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS i)
  )
),
bytes AS (
  SELECT run, n, list_prepend(4294967295, flatten(list_transform(string_split(named, ''), lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)::BIGINT] ELSE [(192 | (ord(c) >> 6))::BIGINT, (128 | (ord(c) & 63))::BIGINT] END))) AS b
  FROM once
),
hashed AS (SELECT run, n, xor(list_reduce(b, lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8)), 4294967295) AS h FROM bytes, crc),
cut AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::INTEGER) || substr(run, (h % length(run))::INTEGER + 2) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM cut WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
less AS (SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, unnest(range(length(word)))::INTEGER AS i FROM words)),
near AS (
  SELECT a.word, b.word AS near FROM less a JOIN less b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word FROM less a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word FROM less a JOIN words b ON a.rest = b.word
),
best AS (SELECT near.word, count(*) AS n_near, min((-m.n, near.near)) AS b FROM near JOIN words m ON m.word = near.near GROUP BY near.word),
forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -b[1] >= 5 * w.n THEN b[2] END AS form, CASE WHEN -b[1] >= 5 * w.n THEN -b[1] END AS form_n
  FROM words w LEFT JOIN best USING (word)
),
walk AS (
  SELECT word, coalesce(form, word) AS at FROM forms
  UNION SELECT walk.word, forms.form FROM walk JOIN forms ON forms.word = walk.at WHERE forms.form IS NOT NULL
),
last AS (SELECT walk.word, walk.at AS root FROM walk JOIN forms ON forms.word = walk.at WHERE forms.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN last USING (word)
"""


@query("op11_spelling_variants", SQL)
def op11(spark, sf_dir):
    return grouped(documents(spark, sf_dir))
