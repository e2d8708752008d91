"""Benchmark decontamination by a hash set of normalised word windows, with DataFrame and SQL functions alone.

Benchmark items become windows of `width` words (a shorter item is one window). As long as these are at most `most_windows`,
counted with the items that have them, they form hash sets that the driver broadcasts to the executors with the stage's plan:
one of the hashes of windows' first words, by which the windows of each document are looked up inside its row, and one of
whole windows, by which those that hit are verified. Nothing is shuffled but the hits.

The sets of a larger benchmark would not fit a plan. Then documents' windows meet the benchmark's by their hashes alone, 8 bytes
each, in a join whose benchmark side is broadcast up to BROADCAST hashes and shuffled beyond; only where a hash hits are words
taken, in a second join that verifies them, and the documents are joined to their hits by a row number.

Defined cases: a null or wordless text has no words and no hits; null ids and repeated rows give rows of their own; a null
or wordless item has no windows; items that repeat an id count once; an item without an id hits words but is not among the
items counted; an empty documents table gives no rows and an empty benchmark no hits; decontaminate keeps further columns,
whatever their names, and contamination does not read them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table, unused
from .words import ANY_CASE_WORD, words_of, words_sql

WIDTH = 10
MOST_WINDOWS = 200_000
BROADCAST = 2_000_000
#: Words at a window's start that are looked up first.
PREFIX = 3
NO_HITS = "CAST(array() AS array<struct<at: int, size: int>>)"


def item_windows(benchmark: DataFrame, width: int = WIDTH, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id string, size, window): each distinct window of an item, its words joined by spaces."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item_id"), words_of(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    items = items.withColumn("size", F.least(F.size("w"), F.lit(width)))
    at = items.withColumn("at", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("size") + 1)))
    return at.select("item_id", "size", F.array_join(F.slice("w", F.col("at"), F.col("size")), " ").alias("window")).distinct()


class Windows:
    """The windows of a benchmark, read once. small: they fit the bound and are held as sets."""

    def __init__(self, benchmark: DataFrame, width: int = WIDTH, most_windows: int = MOST_WINDOWS, item_col: str = "item_id", text_col: str = "text", broadcast: int = BROADCAST):
        self.frame = materialize(item_windows(benchmark, width, item_col, text_col), "windows")
        self.broadcast = broadcast
        self.sizes = sorted(r[0] for r in self.frame.select("size").distinct().collect())  # width of them at most
        self.small = self.frame.count() <= most_windows
        self.prefix = min([PREFIX, *self.sizes])
        self.prefixes, self.sets = "", {}  # SQL lists
        if self.small and self.sizes:
            words = F.split("window", " ")
            each = self.frame.select("size", "window").distinct()
            held: dict[int, list[str]] = {}
            starts = set()
            for r in each.select("size", "window", F.xxhash64(F.slice(words, 1, self.prefix)).alias("p")).collect():  # most_windows at most
                held.setdefault(r["size"], []).append(f"'{r['window']}'")  # words hold neither quotes nor backslashes
                starts.add(r["p"])
            self.prefixes = ",".join(f"{p}L" for p in sorted(starts))
            self.sets = {n: ",".join(windows) for n, windows in held.items()}

    def hits_sql(self, w: str) -> str:
        """array<struct<at, size>>: where windows of the set begin in the words array w, counted from 1."""
        if not self.sets:
            return NO_HITS
        p, parts = self.prefix, []
        for n, windows in sorted(self.sets.items()):
            where = f"i + {n - 1} <= size({w}) AND array_join(slice({w}, i, {n}), ' ') IN ({windows})"
            parts.append(f"transform(filter(c, i -> {where}), i -> named_struct('at', i, 'size', {n}))")
        starts = f"filter(sequence(1, size({w}) - {p - 1}), i -> xxhash64(slice({w}, i, {p})) IN ({self.prefixes}))"
        return f"CASE WHEN size({w}) >= {p} THEN transform(array({starts}), c -> concat({', '.join(parts)}))[0] ELSE {NO_HITS} END"

    def mark(self, docs: DataFrame, text_col: str) -> tuple[DataFrame, str]:
        """docs with one more column, whose name is returned: a struct of n (words), w (the words, empty without hits) and hits."""
        name = unused("_m", docs)
        if not self.small:
            return self._joined(docs, text_col, name), name
        return docs.withColumn(name, F.expr(_marked(words_sql(f"`{text_col}`"), self.hits_sql("w")))), name

    def _joined(self, docs: DataFrame, text_col: str, name: str) -> DataFrame:
        """The same for a benchmark beyond the bound. Rows get a number and are written, so that it stays the same."""
        row, held = unused("_row", docs), unused("_hits", docs)
        docs = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "decontaminate")
        words = docs.select(F.col(row).alias("row"), words_of(F.col(f"`{text_col}`")).alias("w"))
        # The hashes of a row's windows leave as an array for each size, so that positions do not copy its words.
        sizes = F.array(*(F.struct(F.lit(n).alias("size"), F.when(F.size("w") >= n, F.transform(F.sequence(F.lit(1), F.size("w") - (n - 1)), lambda i: F.xxhash64(F.slice("w", i, n)))).alias("hashes")) for n in self.sizes)) if self.sizes else F.expr("CAST(array() AS array<struct<size: int, hashes: array<bigint>>>)")
        each = words.select("row", F.explode(sizes).alias("s")).select("row", "s.size", F.posexplode("s.hashes").alias("pos", "h"))
        keys = self.frame.select("size", F.xxhash64(F.split("window", " ")).alias("h")).distinct()
        if keys.count() <= self.broadcast:
            keys = F.broadcast(keys)
        likely = each.join(keys, ["size", "h"], "left_semi").groupBy("row").agg(F.collect_list(F.struct((F.col("pos") + 1).alias("at"), "size")).alias("c"))
        some = words.join(likely, "row").select("row", "w", F.explode("c").alias("c"))
        some = some.select("row", "c", F.col("c.size").alias("size"), F.array_join(F.slice("w", F.col("c.at"), F.col("c.size")), " ").alias("window"))
        hits = some.join(self.frame.select("size", "window").distinct(), ["size", "window"], "left_semi").groupBy("row").agg(F.collect_list("c").alias(held)).withColumnRenamed("row", row)
        marked = F.expr(_marked(words_sql(f"`{text_col}`"), f"coalesce(`{held}`, {NO_HITS})")).alias(name)
        return docs.join(hits, row, "left").select(*[F.col(f"`{c}`") for c in docs.columns if c != row], marked)


def _marked(words: str, hits: str) -> str:
    """SQL for the struct of a row: words and hits are SQL, the latter over the words w."""
    found = f"transform(array(named_struct('w', w, 'hits', {hits})), x -> named_struct('n', size(x.w), 'w', CASE WHEN size(x.hits) > 0 THEN x.w ELSE CAST(array() AS array<string>) END, 'hits', x.hits))[0]"
    return f"transform(array({words}), w -> {found})[0]"


def hit_words(m: str) -> Column:
    """The numbers of the words inside any hit, each once."""
    return F.expr(f"array_distinct(flatten(transform(`{m}`.hits, x -> sequence(x.at, x.at + x.size - 1))))")


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, most_windows: int = MOST_WINDOWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    windows = Windows(benchmark, width, most_windows)
    marked, m = windows.mark(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), "text")
    found = F.expr(f"array_distinct(transform({m}.hits, x -> array_join(slice({m}.w, x.at, x.size), ' ')))")
    rows = marked.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.col(f"{m}.n").cast("long").alias("n_words"), F.size(hit_words(m)).cast("long").alias("n_hit"), found.alias("found"))
    items = windows.frame.select("item_id", "window")
    keys = ["row", "doc_id", "n_words", "n_hit"]
    if windows.small:  # the bound holds for these rows, too
        each = rows.select(*keys, F.explode_outer("found").alias("window")).join(F.broadcast(items), "window", "left")
        by_row = each.groupBy(*keys).agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    else:
        rows = materialize(rows, "contamination")
        each = rows.where(F.size("found") > 0).select(*keys, F.explode("found").alias("window")).join(items, "window")
        by_row = each.groupBy(*keys).agg(F.array_sort(F.collect_set("item_id")).alias("items"))
        # Rows without a hit have no window to be joined by.
        by_row = by_row.unionByName(rows.where(F.size("found") == 0).select(*keys, F.expr("CAST(array() AS array<string>)").alias("items")))
    return by_row.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, drop_share: float = 0.5, width: int = WIDTH, most_windows: int = MOST_WINDOWS, text_col: str = "text") -> DataFrame:
    """The same columns. Words inside hits are cut out of the text, each with the gap after it; a document goes if at least
    drop_share of its words are hit. Rows without a hit stay as they are."""
    marked, m = Windows(benchmark, width, most_windows).mark(docs, text_col)
    hit = unused("_hit", marked)
    marked = marked.withColumn(hit, hit_words(m))
    kept = marked.where((F.size(hit) == 0) | (F.size(hit) < drop_share * F.col(f"`{m}`.n")))
    text = F.col(f"`{text_col}`")
    pieces = F.struct(F.regexp_extract_all(text, F.lit(f"({ANY_CASE_WORD})"), F.lit(1)).alias("w"), F.split(text, ANY_CASE_WORD, -1).alias("gap"), F.col(hit).alias("hit"))
    cut = F.get(
        F.transform(F.array(pieces), lambda p: F.concat(F.get(p["gap"], F.lit(0)), F.array_join(F.transform(p["w"], lambda w, i: F.when(F.array_contains(p["hit"], i + 1), F.lit("")).otherwise(F.concat(w, F.get(p["gap"], i + 1)))), ""))),
        F.lit(0),
    )
    return kept.select(*[F.when(F.size(hit) > 0, cut).otherwise(text).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP3_SQL = rf"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
  FROM b, unnest(generate_series(1, len(w) - least(len(w), 10) + 1)) AS t(i) WHERE len(w) > 0),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM d, sizes, unnest(generate_series(1, len(w) - n + 1)) AS t(i) WHERE len(w) >= n),
hits AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
n_hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM hits, unnest(generate_series(i, i + n - 1)) AS t(k) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n_hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""
