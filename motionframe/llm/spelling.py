"""Spelling variant grouping: near words, the form that each word stands for, and the root that its forms lead to.

Two words are near if one becomes the other by one inserted, deleted or replaced code point.  Words of T code points are sorted
forwards and backwards; those that start with a prefix are an interval of the first order, those that end with a suffix one of
the second, and the words that match a word but for one place are the points of a rectangle.  A wavelet tree over the places of
the words in both orders reports them.  A word looks itself up in the tree of its own length with one place left open, and in that
of the next length with one place added; deletions are those found the other way round.  An added code point counts at the first
place where adding it gives the word, so no pair is found twice.

Spark deals the words out so that no tree grows with the vocabulary: an edit leaves the first or the last k = (T - 1) // 2 code
points alone, so a word goes to the group of words with its first k, which opens the places from k on, and to that with its last
k, which opens those before.  A group of more than ``LARGE`` rows is dealt out again by place: all but the open code point must
agree there, which leaves at most an alphabet's words a group.  Groups share buckets of about ``BUCKET_ROWS`` rows and
``BUCKET_BYTES`` bytes, and a bucket is one task's work.  Each bucket sends one row a word: how many near words, and the best.

Edge cases: null texts have no words; a null doc_id counts as an empty string in a run's number; rows that repeat count each time;
an empty table gives no words; words of any length take part; of near words used equally often the first in code-point order is
the form; other columns are left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motionframe.llm import workspace
from motionframe.llm.wavelet import WaveletTree

LEAST_LENGTH = 7
LEAST_COUNT = 2
#: A form is used so many times as often as its variant.
RATIO = 10
#: One run in so many loses a code point, as the contract has it.
NOISE = 31
LARGE = 20_000
BUCKET_ROWS = 50_000
BUCKET_BYTES = 2_000_000
#: Rectangles asked for at once.
_AT_ONCE = 200_000
_RUN = rf"[A-Za-zÀ-ÿ]{{{LEAST_LENGTH},}}"


def words(docs: DataFrame) -> DataFrame:
    """word and n (long, its occurrences) of the runs of letters in ``docs`` (doc_id, text); one run in ``NOISE`` lost a code point."""
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    # shorter runs give no words, and a run that is too short does not match in part
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.explode(F.regexp_extract_all(lower, F.lit(_RUN), F.lit(0))).alias("run"))
    number = runs.withColumn("number", F.crc32(F.concat("doc", F.lit(":"), "run").cast("binary")))
    gone = "int(number % length(run))"
    result = number.select(F.expr(f"CASE WHEN number % {NOISE} = 0 THEN concat(left(run, {gone}), substring(run, {gone} + 2)) ELSE run END").alias("word"))
    return result.filter(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def _rows(vocabulary: DataFrame) -> DataFrame:
    """Each word with the trees that it is in (own) or asks (not own), the places open there, and the code points that must agree."""
    row = "named_struct('length', {t}, 'own', {own}, 'first', {first}, 'last', {last}, 'same', {same})"
    made = []
    for own, t in (("true", "length(word)"), ("false", "length(word) + 1")):
        k = f"(({t} - 1) div 2)"
        made.append(row.format(t=t, own=own, first=f"int({k})", last=f"{t} - 1", same=f"left(word, int({k}))"))
        made.append(row.format(t=t, own=own, first="0", last=f"int({k}) - 1", same=f"right(word, int({k}))"))
    return vocabulary.select("word", "n", F.explode(F.expr(f"array({', '.join(made)})")).alias("r")).select("word", "n", "r.*").withColumn("key", F.xxhash64("length", "first", "same")).drop("same")


def _dealt(vocabulary: DataFrame, large: int) -> DataFrame:
    """The rows with the key of their group; groups that are too large are divided by the open place."""
    rows = _rows(vocabulary)
    hot = workspace.cut(rows.groupBy("key").agg(F.count("*").alias("size")).filter(F.col("size") > large).select("key"))
    if hot.isEmpty():
        return rows
    hot = workspace.sized(hot)
    several = rows.join(hot, "key", "left_semi").withColumn("place", F.explode(F.sequence("first", "last")))
    rest = F.expr("substring(word, place + 1 + int(own))")  # the code point at the place is open in words of the tree, and missing in others
    single = several.select("word", "n", "length", "own", F.col("place").alias("first"), F.col("place").alias("last"), F.xxhash64("length", "place", F.expr("left(word, place)"), rest).alias("key"))
    return rows.join(hot, "key", "left_anti").select(*single.columns).unionByName(single)


def _classes(order: np.ndarray, table: np.ndarray) -> np.ndarray:
    """How many leading code points each row of ``table`` shares with the row before it in ``order``; -1 for the first."""
    if len(order) < 2:
        return np.full(len(order), -1, dtype=np.int64)
    differ = table[order[1:]] != table[order[:-1]]
    return np.concatenate([[-1], np.where(differ.any(1), differ.argmax(1), table.shape[1])])


def _intervals(shared: np.ndarray, depth: int, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place in an order: the range of the tree's words that share ``depth`` code points with the row there."""
    starts = np.flatnonzero(shared < depth)
    of = np.cumsum(shared < depth) - 1
    edges = before[np.append(starts, len(shared))]
    return edges[:-1][of], edges[1:][of]


class _Orders:
    """Words of one tree and words that ask it, sorted forwards and backwards together."""

    def __init__(self, texts: list[bytes], own: np.ndarray, length: int) -> None:
        self.own, self.length = own, length
        raw = np.frombuffer(b"".join([t.ljust(length, b"\0") for t in texts]), dtype=np.uint8).reshape(len(texts), length)
        back = np.frombuffer(b"".join([t[::-1].ljust(length, b"\0") for t in texts]), dtype=np.uint8).reshape(len(texts), length)
        self.table = raw
        self.forward, self.backward = (np.argsort(np.ascontiguousarray(t).view(f"S{length}").ravel(), kind="stable") for t in (raw, back))
        self.shared_f, self.shared_b = _classes(self.forward, raw), _classes(self.backward, back)
        self.before_f, self.before_b = (np.concatenate([[0], np.cumsum(own[o])]) for o in (self.forward, self.backward))
        members_f, members_b = self.forward[own[self.forward]], self.backward[own[self.backward]]
        rank = np.empty(len(texts), dtype=np.int64)
        rank[members_b] = np.arange(len(members_b))
        self.by_rank = members_b
        self.tree = WaveletTree(rank[members_f]) if len(members_f) else None

    def pairs(self, first: int, last: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(asking, found) rows that match but for one code point at a place from ``first`` to ``last``."""
        if self.tree is None:
            return
        # no rectangle holds another word where the orders share less than prefix and suffix ask for
        last = min(last, int(self.shared_f.max(initial=-1)))
        first = max(first, self.length - 1 - int(self.shared_b.max(initial=-1)))
        n = len(self.own)
        for place in range(first, last + 1):
            sides = []
            for order, shared, before, depth in ((self.forward, self.shared_f, self.before_f, place), (self.backward, self.shared_b, self.before_b, self.length - 1 - place)):
                low, high = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
                low[order], high[order] = _intervals(shared, depth, before)
                sides += [low, high]
            # a word of the tree is in its own intervals, so one word there is itself
            asking = np.flatnonzero((sides[1] - sides[0] > self.own) & (sides[3] - sides[2] > self.own))
            for at in range(0, len(asking), _AT_ONCE):
                some = asking[at : at + _AT_ONCE]
                which, value = self.tree.report(*[s[some] for s in sides])
                a, b = some[which], self.by_rank[value]
                new = a != b
                if place:  # a code point that repeats the one before it was added there already
                    new &= self.own[a] | (self.table[b, place] != self.table[b, place - 1])
                yield a[new], b[new]


def _found(frame: pd.DataFrame) -> pd.DataFrame:
    """word, n_near and the best near word with its count, as far as a bucket's groups show them."""
    out = []
    for (length, first, last), part in frame.groupby(["length", "first", "last"], sort=False):
        texts = [w.encode("latin-1") for w in part["word"]]
        own, n = part["own"].to_numpy(bool), part["n"].to_numpy(np.int64)
        # rows of different keys cannot match on these places, so the groups of a bucket share a tree
        for a, b in _Orders(texts, own, int(length)).pairs(int(first), int(last)):
            word, near = np.concatenate([a, b[~own[a]]]), np.concatenate([b, a[~own[a]]])
            if len(word):
                out.append(pd.DataFrame({"word": part["word"].to_numpy()[word], "form_n": n[near], "form": part["word"].to_numpy()[near]}))
    if not out:
        return pd.DataFrame({"word": pd.Series(dtype=str), "n_near": pd.Series(dtype="int64"), "form_n": pd.Series(dtype="int64"), "form": pd.Series(dtype=str)})
    every = pd.concat(out).sort_values(["form_n", "form"], ascending=[False, True], kind="stable")
    best = every.drop_duplicates("word").set_index("word")
    return best.assign(n_near=every["word"].value_counts()).reset_index()[["word", "n_near", "form_n", "form"]]


def near(vocabulary: DataFrame, large: int = LARGE) -> DataFrame:
    """word, n_near, and the near word that is used most (best, best_n) of the words of ``vocabulary`` (word, n) that have one."""
    dealt = workspace.cut(_dealt(vocabulary, large))
    total = dealt.agg(F.count("*").alias("rows"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")).first()
    spread = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(spread, total.rows // BUCKET_ROWS + 1, total.bytes // BUCKET_BYTES + 1)
    placed = dealt.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets))).repartition(min(buckets, max(spread, 20_000)), "bucket")
    found = placed.groupBy("bucket").applyInPandas(_found, "word string, n_near long, form_n long, form string")
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n_near", F.col("best.form").alias("best"), (-F.col("best.less")).alias("best_n"))


def rooted(forms: DataFrame) -> DataFrame:
    """``forms`` (word, form, ...) with ``root``, the end of the chain of forms; a form is used ``RATIO`` times as often, so chains end."""
    now = workspace.cut(forms.filter("form IS NOT NULL").select("word", F.col("form").alias("root")))
    while True:  # each turn doubles the length of chain that is followed
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        now = workspace.cut(now.join(ahead, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")))
        settled, now = now.filter("moved").isEmpty(), now.drop("moved")
        if settled:
            return forms.join(now, "word", "left").withColumn("root", F.coalesce("root", "word"))


def variants(docs: DataFrame, large: int = LARGE) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of ``docs`` (doc_id, text)."""
    vocabulary = workspace.cut(words(docs))
    known = vocabulary.join(near(vocabulary, large), "word", "left")
    is_form = F.col("best_n") >= RATIO * F.col("n")
    formed = known.select("word", F.when(is_form, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best_n")).alias("form_n"))
    return rooted(workspace.cut(formed)).select("word", "form", "root", "n", "n_near", "form_n")


SQL = r"""
WITH RECURSIVE crc_table AS (
  SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v FROM range(256) AS r(i))
), runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents
), long_runs AS (SELECT doc, run, count(*) AS n FROM runs WHERE length(run) >= 7 GROUP BY ALL),
in_bytes AS (
  SELECT run, n, flatten(list_transform(string_split(doc || ':' || run, ''), lambda c: CASE WHEN ord(c) < 128 THEN [CAST(ord(c) AS BIGINT)] ELSE [CAST(192 | (ord(c) >> 6) AS BIGINT), CAST(128 | (ord(c) & 63) AS BIGINT)] END)) AS b
  FROM long_runs
), hashed AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295, b), lambda a, x: xor(a >> 8, t[1 + (xor(a, x) & 255)])), 4294967295) AS h FROM in_bytes, crc_table
), noisy AS (
  SELECT CASE WHEN h % 31 = 0 THEN left(run, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) AS INTEGER) + 2) ELSE run END AS word, n FROM hashed
), vocabulary AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM noisy WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
opened AS (
  SELECT word, n, i, left(word, i - 1) AS head, substr(word, i + 1) AS tail FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM vocabulary)
), pairs AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM opened a JOIN opened b ON a.i = b.i AND a.head = b.head AND a.tail = b.tail AND a.word != b.word
  UNION SELECT o.word, v.word, v.n FROM opened o JOIN vocabulary v ON o.head || o.tail = v.word
  UNION SELECT v.word, o.word, o.n FROM opened o JOIN vocabulary v ON o.head || o.tail = v.word
), best AS (
  SELECT word, count(*) OVER (PARTITION BY word) AS n_near, near, near_n FROM pairs QUALIFY row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) = 1
), formed AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 10 * v.n THEN near END AS form, CASE WHEN near_n >= 10 * v.n THEN near_n END AS form_n FROM vocabulary v LEFT JOIN best USING (word)
), chain AS (
  SELECT word, form AS at FROM formed WHERE form IS NOT NULL
  UNION ALL SELECT c.word, f.form FROM chain c JOIN formed f ON f.word = c.at WHERE f.form IS NOT NULL
), ends AS (SELECT c.word, c.at FROM chain c JOIN formed f ON f.word = c.at WHERE f.form IS NULL)
SELECT f.word, form, coalesce(e.at, f.word) AS root, n, CAST(n_near AS BIGINT) AS n_near, form_n FROM formed f LEFT JOIN ends e USING (word)
"""
