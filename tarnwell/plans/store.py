"""A stored index: base tables and the changes since.

A version is a folder with base tables and, beside them, the changes in numbered
parts; a part holds the rows of the pages it puts in or replaces, signed changes of
counts, and the keys it touches.  An update therefore writes as much as it changes.
A row counts while no later part touches its page.  Lookups read the base tables
by sorted columns: postings and lemmas by lemma, pages by site and path in each file, as
they stay with the task that read them.  A page's row also holds its postings, counted where
the page is read, so what an update takes away is found by page key.

What counts is said by a log of numbered entries, each the version and the folders of
its parts.  An entry is created only if its number is free, so of two writers that began
on one state one commits and the other is refused; what a writer leaves without an
entry is never read.

Parts are merged in levels: the last ``FANOUT`` or more parts of one level (by the power
of FANOUT that their number of touched keys has) become one part, so a row is written
once a level and n updates of a page write O(n log n) rows.  Only when the touched keys
are too many to be broadcast is everything written anew as the next version; the version before stays for readers that began on it,
older ones are deleted.
"""

from __future__ import annotations

import json
import uuid
from contextlib import nullcontext

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.analyzer import Analyzer, Dictionary
from ..operators import index
from ..sources.scratch import create_new, read_text

TERMS = "array<struct<lemma: string, rank: float>>"
SCHEMAS = {
    "pages": f"site_url string, path string, code int, content string, ts timestamp, terms {TERMS}",
    "postings": "lemma string, site_url string, path string, rank float",
    "lemmas": "lemma string, site_url string, frequency int",
    "counts": "site_url string, pages long, good_pages long",
    "touched": "site_url string, path string",
    "sites": "site_url string, name string, status string, status_time timestamp, last_error string",
}
SORTED_BY = {"pages": ["site_url", "path"], "postings": ["lemma", "site_url"], "lemmas": ["lemma", "site_url"]}
FANOUT = 4
MAX_PARTS = 64  # levels keep them below that
MAX_TOUCHED = 100_000  # keys that the parts of a version touch; they are broadcast
MAX_LITERALS = 64  # keys that become conditions of the scan


def _name() -> str:
    """A name for a part's folders that no other writer has."""
    return f"part-{uuid.uuid4().hex}"


def _without_seq(df: DataFrame) -> DataFrame:
    return df.drop("seq")


def level(weight: int) -> int:
    """The power of FANOUT that a part's touched keys have."""
    n = 0
    while weight >= FANOUT:
        weight, n = weight // FANOUT, n + 1
    return n


def merge_from(weights: list[int]) -> int | None:
    """Where the parts begin that are to be merged: the last FANOUT or more, if none
    before them and among them is of a higher level; null if there are too few."""
    start = len(weights)
    while start and level(weights[start - 1]) <= level(weights[-1]):
        start -= 1
    return start if len(weights) - start >= FANOUT else None


class ConcurrentWrite(RuntimeError):
    """Another writer has changed the index since this one began."""


class Store:
    """The tables of an index in ``folder``.  ``deciding`` makes a context in which an
    operation commits: it may raise, and nothing is committed then."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.deciding = nullcontext
        self.merged: list[tuple[int, str, int]] = []
        self.refresh()

    @property
    def part(self) -> int:
        """The number of the last part; numbers grow, merged parts keep the last one's."""
        return self.parts[-1][0] if self.parts else 0

    def refresh(self) -> None:
        """Go to the newest state; version 0 is an index without tables."""
        self.entry = max(self._numbers(f"{self.folder}/log", "entry-"), default=0)
        state = json.loads(read_text(self.spark, self._entry(self.entry))) if self.entry else {"version": 0, "parts": []}
        self.version, self.parts = state["version"], [tuple(p) for p in state["parts"]]

    def _entry(self, number: int) -> str:
        return f"{self.folder}/log/entry-{number}"

    def _commit(self, version: int, parts: list[tuple[int, str, int]], decided: bool = False) -> None:
        """Make ``parts`` (number, folder, touched keys) what counts, unless another
        writer was faster."""
        with nullcontext() if decided else self.deciding():
            if not create_new(self.spark, self._entry(self.entry + 1), json.dumps({"version": version, "parts": parts})):
                self._drop(version, parts[-1][1])
                self.refresh()
                raise ConcurrentWrite("the index was changed by another writer")
            self.entry, self.version, self.parts = self.entry + 1, version, parts

    def _drop(self, version: int, part: str) -> None:
        """Delete the folders of a part that doesn't count."""
        for name in SCHEMAS:
            for seq in self._numbers(f"{self.folder}/v{version}/{name}", "seq="):
                there, files = self._hadoop(f"{self.folder}/v{version}/{name}/seq={seq}/{part}")
                files.delete(there, True)

    # files

    def _hadoop(self, path: str):
        there = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return there, there.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _exists(self, path: str) -> bool:
        there, files = self._hadoop(path)
        return files.exists(there)

    def _numbers(self, path: str, prefix: str) -> list[int]:
        """n of the folders ``prefix``n in a folder."""
        there, files = self._hadoop(path)
        names = [s.getPath().getName() for s in files.listStatus(there)] if files.exists(there) else []
        return sorted(int(n[len(prefix) :]) for n in names if n.startswith(prefix) and n[len(prefix) :].isdigit())

    def _path(self, name: str, seq: int, part: str | None = None, version: int | None = None) -> str:
        """The folder of a part's table: of one that counts, or of a new one."""
        return f"{self.folder}/v{self.version if version is None else version}/{name}/seq={seq}/{part or dict(p[:2] for p in self.parts)[seq]}"

    def _write(self, df: DataFrame, name: str, seq: int, part: str, version: int | None = None) -> None:
        df = df.select(*[F.col(c).cast(kind) for c, kind in ((f.name, f.dataType) for f in self._empty(name).schema)])
        if name in SORTED_BY:
            if not seq and name != "pages":
                df = df.repartitionByRange(*SORTED_BY[name])
            if seq or name != "pages":  # base pages were sorted before their terms were counted
                df = df.sortWithinPartitions(*SORTED_BY[name])
        df.write.parquet(self._path(name, seq, part, version))

    def _empty(self, name: str) -> DataFrame:
        return self.spark.createDataFrame([], SCHEMAS[name])

    def _rows(self, name: str, first: int = 0) -> DataFrame:
        """Rows of the parts from ``first`` on that count, with their number; part
        0 is the base."""
        paths = [p for p in (self._path(name, k) for k, *_ in self.parts if k >= first) if self.version and self._exists(p)]
        if not paths:
            return self._empty(name).withColumn("seq", F.lit(0))
        reader = self.spark.read.schema(f"{SCHEMAS[name]}, seq int").option("basePath", f"{self.folder}/v{self.version}/{name}")
        return reader.parquet(*paths)

    # tables

    def _live(self, rows: DataFrame) -> DataFrame:
        """Rows whose page no later part touches."""
        if not self.part:
            return _without_seq(rows)
        last = F.broadcast(self._rows("touched", 1).groupBy("site_url", "path").agg(F.max("seq").alias("last")))  # at most MAX_TOUCHED
        return rows.join(last, ["site_url", "path"], "left").filter(F.col("last").isNull() | (F.col("seq") >= F.col("last"))).drop("seq", "last")

    def pages(self) -> DataFrame:
        return self._live(self._rows("pages"))

    def postings(self) -> DataFrame:
        return self._live(self._rows("postings")).select("site_url", "path", "lemma", "rank")

    def _summed(self, name: str, keys: list[str], values: list[str]) -> DataFrame:
        if not self.part:
            return _without_seq(self._rows(name))
        kinds = dict(self._empty(name).dtypes)
        return self._rows(name).groupBy(*keys).agg(*[F.sum(v).cast(kinds[v]).alias(v) for v in values])

    def lemmas(self) -> DataFrame:
        return self._summed("lemmas", ["lemma", "site_url"], ["frequency"]).filter("frequency > 0").select("site_url", "lemma", "frequency")

    def counts(self) -> DataFrame:
        """(site_url, pages, good_pages)."""
        return self._summed("counts", ["site_url"], ["pages", "good_pages"])

    def sites(self) -> DataFrame:
        if not self.version:
            return self._empty("sites")
        return self.spark.read.schema(SCHEMAS["sites"]).parquet(self._path("sites", self.part))

    def table(self, name: str) -> DataFrame:
        return {"pages": lambda: self.pages().select("site_url", "path", "code", "content"), "postings": self.postings, "lemmas": self.lemmas, "counts": self.counts, "sites": self.sites}[name]()

    def _forward(self, keys: DataFrame | None = None, at: Column | None = None) -> DataFrame:
        pages = self._rows("pages").select("site_url", "path", "code", "ts", "terms", "seq")
        return self._live(pages.filter(at) if at is not None else pages.join(F.broadcast(keys), ["site_url", "path"], "left_semi"))

    def postings_by_page(self, site_url: str, path: str) -> DataFrame:
        """The postings of a page, from the row of the page."""
        row = self._forward(at=(F.col("site_url") == site_url) & (F.col("path") == path))
        terms = row.select("site_url", "path", F.explode("terms").alias("t")).select("site_url", "path", "t.lemma", "t.rank")
        return terms.groupBy("site_url", "path", "lemma").agg(F.sum("rank").cast("float").alias("rank"))

    # writing

    def build(self, pages: DataFrame, sites: DataFrame, analyzer: Analyzer, dictionary: Dictionary | None = None, is_html: bool = True) -> None:
        """The next version, of pages (site_url, path, code, content, ts).  Of rows of one key
        each counts its own words, which add up."""
        self._base(index.with_terms(pages.sortWithinPartitions(*SORTED_BY["pages"]), analyzer, dictionary, is_html), sites)

    def _base(self, pages: DataFrame, sites: DataFrame, decided: bool = False) -> None:
        """The next version, of pages with their terms, sorted.  Pages are written where they were
        read; the postings come from their rows and are what is shuffled, once."""
        version, part = max(self.version, *self._numbers(self.folder, "v"), 0) + 1, _name()
        path = lambda name: self._path(name, 0, part, version)
        self._write(pages, "pages", 0, part, version)
        pages = self.spark.read.schema(SCHEMAS["pages"]).parquet(path("pages"))
        posts = pages.select("site_url", "path", F.explode("terms").alias("t")).select("site_url", "path", "t.lemma", "t.rank")
        if not pages.groupBy("site_url", "path").count().filter("count > 1").isEmpty():
            posts = posts.groupBy("site_url", "path", "lemma").agg(F.sum("rank").alias("rank"))
        self._write(posts, "postings", 0, part, version)
        posts = self.spark.read.schema(SCHEMAS["postings"]).parquet(path("postings"))
        self._write(index.frequencies(posts), "lemmas", 0, part, version)
        self._write(self._counts_of(pages), "counts", 0, part, version)
        self._write(sites, "sites", 0, part, version)
        before = self.version
        self._commit(version, [(0, part, 0)], decided)
        self.merged = []
        for old in self._numbers(self.folder, "v"):
            if old < before:
                there, files = self._hadoop(f"{self.folder}/v{old}")
                files.delete(there, True)

    @staticmethod
    def _counts_of(pages: DataFrame, sign: int = 1) -> DataFrame:
        return pages.groupBy("site_url").agg((sign * F.count("*")).alias("pages"), (sign * F.count_if(F.col("code").eqNullSafe(index.GOOD_CODE))).alias("good_pages"))

    def mark(self, sites: DataFrame) -> None:
        """The same index with another table of sites, whatever was decided."""
        if not self.version:
            self._base(self._empty("pages"), sites, decided=True)
            return
        seq, part = self.part + 1, _name()
        self._write(sites, "sites", seq, part)
        self._commit(self.version, [*self.parts, (seq, part, 0)], decided=True)
        self._merge()

    def update(self, new: DataFrame, sites: DataFrame, analyzer: Analyzer, dictionary: Dictionary | None = None, is_html: bool = True, gone: DataFrame | None = None) -> None:
        """Put in or replace the pages ``new`` (site_url, path, code, content, ts;
        keys unique), and take out the pages ``gone`` (site_url, path).  A new page
        that is older than the stored one is left out; a page without a time is
        newer than any."""
        if not self.version:
            self.build(new, sites, analyzer, dictionary, is_html)
            return
        seq, part = self.part + 1, _name()
        keys = new.select("site_url", "path")
        keys = (keys if gone is None else keys.unionByName(gone.select("site_url", "path"))).distinct()
        self._write(keys, "touched", seq, part)
        keys = self.spark.read.schema(SCHEMAS["touched"]).parquet(self._path("touched", seq, part))
        n_new = keys.count()
        touched = n_new + (self._rows("touched", 1).count() if self.part else 0)
        if len(self.parts) > MAX_PARTS or touched > MAX_TOUCHED:
            self._rebuilt(new, keys, sites, analyzer, dictionary, is_html)
            return
        at = None
        if n_new <= MAX_LITERALS:  # the scan skips what can't hold them
            names = [tuple(r) for r in keys.collect()]
            at = F.lit(False)
            for site, path in names:
                at = at | ((F.col("site_url") == site) & (F.col("path") == path))
        old = self._forward(keys, at)
        before = old.select("site_url", "path", F.col("ts").alias("old_ts"))
        own, kept = new, None
        # a page that is older than the stored one is left out, and that one stays
        late = new.join(F.broadcast(before), ["site_url", "path"]).filter(F.col("ts") < F.col("old_ts")).select("site_url", "path")
        if not late.isEmpty():
            own = new.join(F.broadcast(late), ["site_url", "path"], "left_anti")
            stored = self._rows("pages") if at is None else self._rows("pages").filter(at)
            kept = self._live(stored).join(F.broadcast(late), ["site_url", "path"], "left_semi")
        columns = self._empty("pages").columns
        rows = index.with_terms(own, analyzer, dictionary, is_html).select(*columns)
        self._write(rows if kept is None else rows.unionByName(kept.select(*columns)), "pages", seq, part)
        written = self.spark.read.schema(SCHEMAS["pages"]).parquet(self._path("pages", seq, part))
        exploded = lambda rows, sign: rows.select("site_url", "path", F.explode("terms").alias("t")).select("site_url", "path", "t.lemma", "t.rank", F.lit(sign).alias("frequency"))
        self._write(exploded(written, 1), "postings", seq, part)
        taken = exploded(old, -1).dropDuplicates(["site_url", "path", "lemma"])  # rows of one key are one page
        signed = exploded(written, 1).unionByName(taken).groupBy("lemma", "site_url").agg(F.sum("frequency").alias("frequency"))
        self._write(signed.filter("frequency <> 0"), "lemmas", seq, part)
        counts = self._counts_of(written).unionByName(self._counts_of(old, -1)).groupBy("site_url").agg(F.sum("pages").alias("pages"), F.sum("good_pages").alias("good_pages"))
        self._write(counts, "counts", seq, part)
        self._write(sites, "sites", seq, part)
        self._commit(self.version, [*self.parts, (seq, part, n_new)])
        self._merge()

    def _merge(self) -> None:
        """Merge the last parts while they fill a level.  What they say stays the same,
        so another writer who comes before only makes it needless."""
        while (start := merge_from([w for _, _, w in self.parts[1:]])) is not None:
            first, seq, part = self.parts[start + 1][0], self.part, _name()
            self._write(self._rows("touched", first).select("site_url", "path").distinct(), "touched", seq, part)
            for name in ("pages", "postings"):
                self._write(self._live(self._rows(name, first)), name, seq, part)
            for name, keys, values in (("lemmas", ["lemma", "site_url"], ["frequency"]), ("counts", ["site_url"], ["pages", "good_pages"])):
                sums = self._rows(name, first).groupBy(*keys).agg(*[F.sum(v).alias(v) for v in values])
                self._write(sums.filter(" OR ".join(f"{v} <> 0" for v in values)), name, seq, part)
            self._write(self.sites(), "sites", seq, part)
            weight = self.spark.read.schema(SCHEMAS["touched"]).parquet(self._path("touched", seq, part)).count()
            gone = self.parts[start + 1 :]
            try:
                self._commit(self.version, [*self.parts[: start + 1], (seq, part, weight)], decided=True)
            except ConcurrentWrite:
                return
            for _, old, _ in self.merged:  # of the merge before: readers of one state ago still find theirs
                self._drop(self.version, old)
            self.merged = gone

    def _rebuilt(self, new: DataFrame, keys: DataFrame, sites: DataFrame, analyzer: Analyzer, dictionary: Dictionary | None, is_html: bool) -> None:
        """The next version, with the new pages among the old ones."""
        columns = ["site_url", "path", "code", "content", "ts"]
        old = self.pages()
        own = new.join(old.select("site_url", "path", F.col("ts").alias("old_ts")), ["site_url", "path"], "left").filter(F.coalesce(F.col("ts") >= F.col("old_ts"), F.lit(True))).select(*columns)
        replaced = own.select("site_url", "path")
        gone = keys.join(new.select("site_url", "path"), ["site_url", "path"], "left_anti")
        replaced = replaced.unionByName(gone)
        pages = old.select(*columns, "terms").join(replaced, ["site_url", "path"], "left_anti").unionByName(index.with_terms(own, analyzer, dictionary, is_html).select(*columns, "terms"))
        self._base(pages.sortWithinPartitions(*SORTED_BY["pages"]), sites)

    def delete(self, keys: DataFrame, sites: DataFrame | None = None) -> None:
        """Take out pages (site_url, path)."""
        none = self._empty("pages").drop("terms")
        self.update(none, self.sites() if sites is None else sites, Analyzer("none", lambda c: F.array().cast("array<string>"), lambda t: []), gone=keys)


def newest(pages: DataFrame) -> DataFrame:
    """The last of the pages with one key, by ``ts``."""
    order = Window.partitionBy("site_url", "path").orderBy(F.desc_nulls_first("ts"), F.xxhash64("content"))
    return pages.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")
