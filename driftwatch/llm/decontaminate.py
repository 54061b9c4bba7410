"""Benchmark decontamination in DataFrame operations only: find test windows in training text, cut them out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwatch.llm.common import lowered, private, stored

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GAP = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"  # between words of a text whose case is as it came


def plain_words(text: Column | str) -> Column:
    """The words in lower case with one space between them; without words, the empty text."""
    return F.trim(F.regexp_replace(lowered(text), NOT_WORD, " "))


def _blocks(words: str, width: int) -> Column:
    """The words cut into blocks of ``width`` from the start; what is left over at the end is in no block."""
    return F.regexp_extract_all(F.col(words), F.lit(r"[^ ]++(?: [^ ]++){%d}" % (width - 1)), F.lit(0))


def _windows(words: str, length: int) -> Column:
    return F.expr(f"""if(size({words}) < {length}, array(), transform(sequence(0, size({words}) - {length}),
                      i -> array_join(slice({words}, i + 1, {length}), ' ')))""")


class Benchmark:
    """The windows of a benchmark and what a document must hold to have one of them.

    An occurrence of a window of n words covers a whole block of (n + 1) // 2 words (``block`` at most),
    however the document's blocks lie. So the short grams of the windows are the only thing to look for in
    a first pass, in one block of the document after the other. Up to ``max_grams`` of them go to all
    executors as a set in the filter itself; beyond, documents are found by a join on the grams.
    """

    def __init__(self, items: DataFrame, window: int = 10, block: int = 5, max_grams: int = 200_000):
        words = items.select("item_id", F.split(plain_words("text"), " ").alias("w")).filter("w[0] <> ''")
        words = words.withColumn("length", F.least(F.size("w"), F.lit(window)))
        words = words.withColumn("width", F.least(F.floor((F.col("length") + 1) / 2), F.lit(block)).cast("int"))
        grams = """transform(sequence(0, size(w) - {n}), i -> array_join(slice(w, i + 1, {n}), ' '))"""
        self.windows = stored(
            words.select("item_id", "length", F.explode(F.expr(grams.format(n="length"))).alias("window"))
            .groupBy("length", "window").agg(F.collect_set(F.coalesce(F.col("item_id").cast("string"), F.lit("")))
                                             .alias("items")), "benchmark-windows")
        self.grams = stored(
            words.select("width", F.explode(F.expr(grams.format(n="width"))).alias("g"))
            .select("width", F.xxhash64("g").alias("gram")).distinct(), "benchmark-grams")
        self.lengths = sorted(r[0] for r in self.windows.select("length").distinct().collect())
        self.widths = sorted(r[0] for r in self.grams.select("width").distinct().collect())
        held = self.grams.select("gram").limit(max_grams + 1).collect()
        self.known = None if len(held) > max_grams else sorted({r[0] for r in held})
        self.small = self.known is not None and self.windows.count() <= max_grams

    def suspects(self, docs: DataFrame, words: str, flag: str) -> DataFrame:
        """``docs`` with a boolean ``flag``: some gram of a window is among the blocks of column ``words``."""
        if self.known is not None:
            if not self.known:
                return docs.withColumn(flag, F.lit(False))
            known = ",".join(f"{g}L" for g in self.known)
            blocks = private(docs, "_blocks")
            all_blocks = F.concat(*[_blocks(words, n) for n in self.widths])
            found = F.expr(f"exists({blocks}, b -> xxhash64(b) IN ({known}))")
            return docs.withColumn(blocks, all_blocks).withColumn(flag, found).drop(blocks)
        mine, key = private(docs, "_digest"), private(docs, "_digest_of")
        blocks = F.concat(*[_blocks(words, n) for n in self.widths])
        cut = docs.select(F.sha2(words, 256).alias(key), F.explode(blocks).alias("b"))
        found = cut.select(key, F.xxhash64("b").alias("gram")).join(self.grams.select("gram").distinct(), "gram")
        keys = stored(found.select(key).distinct().withColumn(flag, F.lit(True)), "suspects")
        return (docs.withColumn(mine, F.sha2(words, 256)).join(keys, F.col(mine) == F.col(key), "left")
                .drop(mine, key).withColumn(flag, F.coalesce(F.col(flag), F.lit(False))))

    def hits(self, rows: DataFrame, keys: list[str], words: str) -> DataFrame:
        """Per ``keys``: the merged word ranges that windows cover, and the items they belong to."""
        split = rows.select(*keys, F.split(words, " ").alias("w"))
        windows = F.broadcast(self.windows) if self.small else self.windows
        found = None
        for length in self.lengths:
            at = split.select(*keys, F.posexplode(_windows("w", length)).alias("pos", "window"))
            part = at.join(windows.filter(F.col("length") == length), "window").select(
                *keys, F.struct(F.col("pos").cast("long").alias("pos"), (F.col("pos") + length).cast("long").alias("end")).alias("span"),
                "items")
            found = part if found is None else found.unionByName(part)
        if found is None:
            found = split.select(*keys, F.expr("named_struct('pos', 0L, 'end', 0L)").alias("span"),
                                 F.expr("array('')").alias("items")).filter(F.lit(False))
        merged = F.expr("""aggregate(array_sort(collect_set(span)), cast(array() AS array<struct<pos: bigint, end: bigint>>),
            (a, s) -> if(size(a) > 0 AND s.pos <= element_at(a, -1).end,
                         concat(slice(a, 1, size(a) - 1), array(named_struct('pos', element_at(a, -1).pos,
                                'end', greatest(element_at(a, -1).end, s.end)))),
                         concat(a, array(s))))""")
        return found.groupBy(*keys).agg(
            merged.alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, max_grams: int = 200_000) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items.

    Words are runs of digits, a-z and non-ASCII characters after A-Z are lowered. A window is ``window``
    consecutive words of an item, or a shorter item as a whole; a document's word is hit when an occurrence
    of a window covers it.

    A null or empty text, or one without words, has no words and no hits; so has an item. A null item_id
    counts as an item with the empty name; equal item_ids count once. Rows that repeat each get their own
    row. Empty tables give no rows or no hits. Further columns are not read.
    """
    bench = Benchmark(items, window, max_grams=max_grams)
    rows = bench.suspects(docs.select("doc_id", plain_words("text").alias("words")), "words", "suspect")
    rows = stored(rows.select(
        "doc_id", F.monotonically_increasing_id().alias("row"),
        F.when(F.col("words") == "", 0).otherwise(
            F.length("words") - F.length(F.translate("words", " ", "")) + 1).cast("long").alias("n_words"),
        F.when(F.col("suspect"), F.col("words")).alias("words")), "documents")
    hits = bench.hits(rows.filter("words IS NOT NULL"), ["row"], "words")
    none = F.expr("cast(array() AS array<string>)")
    return rows.join(hits, "row", "left").select(
        "doc_id", "n_words",
        F.expr("coalesce(aggregate(spans, 0L, (n, s) -> n + s.end - s.pos), 0L)").alias("n_hit"),
        F.coalesce(F.size(F.coalesce("items", none)), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.coalesce("items", none), ","), 256).alias("items_sha256"),
        F.col("items").isNotNull().alias("contaminated"), F.coalesce("items", none).alias("items"))


def decontaminated(docs: DataFrame, items: DataFrame, spans: bool = False, window: int = 10,
                   max_grams: int = 200_000) -> DataFrame:
    """``docs`` without contaminated documents, or (``spans``) with the hit words cut out of their texts.

    A cut takes the hit words and what stands between and after them up to the next word. Documents without
    a hit, among them those with null or empty texts, stay as they are; all columns stay.
    """
    bench = Benchmark(items, window, max_grams=max_grams)
    words, flag, key, of, cuts = (private(docs, c) for c in ("_words", "_suspect", "_key", "_key_of", "_cuts"))
    rows = bench.suspects(docs.withColumn(words, plain_words("text")), words, flag)
    clear, suspect = rows.filter(~F.col(flag)), rows.filter(flag).withColumn(key, F.sha2(words, 256))
    hits = bench.hits(suspect.select(key, words).dropDuplicates([key]), [key], words)
    hits = stored(hits.select(F.col(key).alias(of), F.col("spans").alias(cuts)), "contaminated")
    on = F.col(key) == F.col(of)
    if not spans:
        kept = suspect.join(hits, on, "left_anti")
        return clear.select(*docs.columns).unionByName(kept.select(*docs.columns))
    pieces = F.regexp_extract_all("text", F.lit(f"[^{GAP}]+[{GAP}]*"), F.lit(0))
    head = F.regexp_extract("text", f"^[{GAP}]*", 0)
    left = F.filter(pieces, lambda p, i: ~F.exists(cuts, lambda s: (i >= s.pos) & (i < s.end)))
    cut = suspect.join(hits, on, "left").withColumn(
        "text", F.when(F.col(cuts).isNull(), F.col("text")).otherwise(F.concat(head, F.array_join(left, ""))))
    return clear.select(*docs.columns).unionByName(cut.select(*docs.columns))
