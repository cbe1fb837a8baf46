"""The token index of a graph, kept up to date by differences.

The index is a list of generations.  Each holds postings and, added up from
them, the document frequency of its tokens and the number and length of its
documents.  All are counters: what a change takes away is written as negative
rows, so the index is the sum of its generations, and a generation is as large
as its change.  Like sizes are merged, so there are few generations and a row is
written again a logarithmic number of times.

Generations are never changed in place.  Whoever keeps the index also keeps the
list of those that are live, and moves to a new list in one step.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import lexical as L
from ..session import broadcast_if_small

KEYS = ["token", "id", "field", "fresh", "h"]
# A generation is merged with the one before while that is less than so many times its size.
RATIO = 4


def fingerprint() -> Column:
    """A hash of all that is indexed of a document."""
    return F.xxhash64("name", "path", F.col("body"))


def _indexed(docs: DataFrame) -> DataFrame:
    return docs.select("id", "name", "path", L.body_of(docs).alias("body"))


def entries(docs: DataFrame) -> DataFrame:
    """A row per document, field and token, and one per document with its length and hash.

    ``fresh`` marks the first field of a document that holds the token, so that
    it counts once in the document frequency.
    """
    tokens = _indexed(docs).where("id is not null").select("id", *[X.tokenize(F.col(c)).alias(c[0]) for c in ("name", "path", "body")], fingerprint().alias("h"))

    def part(f: str, found: Column, fresh: bool, tf: Column, h: Column | None = None) -> Column:
        return F.struct(F.lit(f).alias("field"), F.lit(fresh).alias("fresh"), (F.lit(None) if h is None else h).cast("long").alias("h"),
                        tf.cast("long").alias("tf"), found.alias("tokens"))

    # all rows of a document come from one pass over its text; which tokens are fresh is told by rows that count nothing
    one, nothing = F.lit(1), F.lit(0)
    parts = F.array(
        part("name", F.col("n"), True, one), part("path", F.col("p"), False, one), part("path", F.array_except("p", "n"), True, nothing),
        part("body", F.col("b"), False, one), part("body", F.array_except(F.array_except("b", "n"), F.col("p")), True, nothing),
        part("", F.array(F.lit("")), False, F.size("b"), F.col("h")))
    rows = tokens.select("id", F.explode(parts).alias("r")).select(
        "id", "r.field", "r.fresh", "r.h", "r.tf", F.explode("r.tokens").alias("token"))
    sign = F.when(F.col("token") == "", F.count("*")).otherwise(F.lit(1))
    grouped = rows.groupBy("token", "id", "field", "h").agg(F.max("fresh").alias("fresh"), F.sum("tf").alias("tf"), sign.cast("long").alias("sign"))
    return grouped.select(*KEYS, "tf", "sign")


@dataclass
class TokenStore:
    """An index below ``at``; ``live`` names its generations with their rows, oldest first."""

    spark: SparkSession
    at: str
    live: list[tuple[str, int]] = field(default_factory=list)

    # -- reading -----------------------------------------------------------

    def _read(self, kind: str, names: list[str] | None = None) -> DataFrame:
        names = names if names is not None else [n for n, _ in self.live]
        return self.spark.read.parquet(*[f"{self.at}/{n}/{kind}" for n in names])

    def _net(self, rows: DataFrame) -> DataFrame:
        summed = rows.groupBy(*KEYS).agg(F.sum("tf").alias("tf"), F.sum("sign").alias("sign"))
        return summed.where("sign <> 0 or tf <> 0")

    def rows(self, where=None) -> DataFrame:
        """What is indexed now; ``where`` reaches the scan."""
        read = self._read("postings")
        read = read if where is None else read.where(where)
        return read if len(self.live) == 1 else self._net(read)

    def _postings(self) -> DataFrame:
        """The rows of tokens.  They need no sums where later generations only add: then no two have one key."""
        tokens, later = F.col("token") != "", [n for n, _ in self.live[1:]]
        if later and self._read("postings", later).where(tokens & (F.col("sign") <= 0)).isEmpty():
            return self._read("postings").where(tokens)
        return self.rows(tokens)

    def index(self) -> L.TokenIndex:
        one = self._read("totals").agg(F.sum("n").alias("n"), F.sum("length").alias("length")).first()  # two numbers
        frequencies = self._read("frequencies")
        if len(self.live) > 1:
            frequencies = frequencies.groupBy("token").agg(F.sum("df").alias("df")).where("df > 0")
        return L.TokenIndex(
            self._postings().select("id", "field", "token", "tf"),
            self.rows(F.col("token") == "").select("id", F.col("tf").alias("body_len")),
            frequencies, one["n"] or 0, (one["length"] or 0) / one["n"] if one["n"] else 0.0)

    # -- changing ----------------------------------------------------------

    def _write(self, name: str, rows: DataFrame) -> int:
        to = f"{self.at}/{name}"
        # rows come grouped, so they are sorted where they are: every file holds all tokens in order, and its pages tell which
        rows.sortWithinPartitions("token", "id").write.mode("overwrite").parquet(f"{to}/postings")
        stored = self._read("postings", [name])
        df = stored.where("fresh").groupBy("token").agg(F.sum("sign").alias("df")).where("df <> 0")
        df.sortWithinPartitions("token").write.mode("overwrite").parquet(f"{to}/frequencies")
        lengths = stored.where("token = ''").agg(F.coalesce(F.sum("sign"), F.lit(0)).alias("n"), F.coalesce(F.sum("tf"), F.lit(0)).alias("length"))
        lengths.write.mode("overwrite").parquet(f"{to}/totals")
        return stored.count()

    def changed(self, docs: DataFrame) -> DataFrame:
        """(id) of documents that are new, gone or different."""
        now = _indexed(docs).select("id", fingerprint().alias("h"))
        if not self.live:
            return now.select("id")
        old = self.rows(F.col("token") == "").select("id", F.col("h").alias("old_h"))
        return now.join(old, "id", "full_outer").where("not (h <=> old_h)").select("id").distinct()

    def update(self, name: str, docs: DataFrame, ids: DataFrame | None = None) -> TokenStore:
        """The index as it is with ``docs``: id, name, path and what ``body_of`` reads, an id once.

        ``ids`` names all documents that may differ, and ``docs`` need then hold
        only those of them that are still there; without it all are compared.
        """
        if not self.live and ids is None:
            rows = entries(docs)  # all is new, so no text meets a list of ids
        else:
            ids = broadcast_if_small(ids.select("id").distinct() if ids is not None else self.changed(docs))
            rows = entries(docs.join(ids, "id", "left_semi"))
        if self.live and self._mostly(ids):
            # it would be merged with all there is, so what stays is taken over and nothing is subtracted
            made = f"{name}-merged"
            stays = self.rows().join(ids, "id", "left_anti").select(*rows.columns)
            return TokenStore(self.spark, self.at, [(made, self._write(made, rows.union(stays)))])
        if self.live:
            gone = self.rows().join(ids, "id", "left_semi")
            rows = self._net(rows.union(gone.select(*KEYS, -F.col("tf"), -F.col("sign"))))
        live = [*self.live, (name, self._write(name, rows))]
        return TokenStore(self.spark, self.at, live)._merged(name)

    def _mostly(self, ids: DataFrame) -> bool:
        """Whether a change of ``ids`` is more than half as large as the index."""
        return 2 * ids.count() > self._read("totals").agg(F.sum("n")).first()[0]

    def _merged(self, name: str) -> TokenStore:
        """Merge the newest generations while the one before is of like size."""
        n = 1
        size = self.live[-1][1]
        while n < len(self.live) and self.live[-n - 1][1] < RATIO * max(size, 1):
            n += 1
            size += self.live[-n][1]
        if n == 1:
            return self
        rows = self._net(self._read("postings", [g for g, _ in self.live[-n:]]))
        made = f"{name}-merged"
        return TokenStore(self.spark, self.at, [*self.live[:-n], (made, self._write(made, rows))])
