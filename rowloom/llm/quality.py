"""Quality rules with thresholds that adapt to language and source.

Each text gives counts; from them come five ratios.  The distribution of each ratio per (lang,
source) is summarised by a mergeable quantile sketch: counts of logarithmic bins, 32 to an octave,
so that quantiles are within 1/32 of their value.  Sketches merge by adding counts, in any order,
with the same outcome.  Small groups use the merged sketch of their language, then of everything.

A group's fence is where its quantiles leave off growing steadily: from a quartile outwards, rank by rank, the
distance from the other quartile may double, and grow by the ratio's resolution, from one rank to the next.  The last quantile before
a longer leap is the fence, the last rank's if there is none.  So a group whose texts all repeat some lines
allows them, and one where a few do nothing else rejects those.  A document is rejected where a ratio lies beyond
its group's fence by more than a few events, as a short text's ratios are rough.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowloom.llm.common import filled, materialise, pieces, slices

SYMBOLS = "#*$%&|<>"
WINDOW = 8  # words
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_echo_words")
#: Ratio, its numerator, denominator and scale, whether it is fenced below too, the events by which a text may pass the fence
#: (characters, symbols, lines, words: a line of 16 words twice, words), and the resolution: about what one event makes of a short text.
RATIOS = (
    ("word_length", "word_chars", "n_words", 100, True, 30, 35),
    ("symbols", "n_symbols", "word_chars", 1000, False, 3, 4),
    ("dup_lines", "n_dup_lines", "n_words", 1000, False, 2, 20),
    ("repeats", "n_repeat_words", "n_words", 1000, False, 32, 80),
    ("echoes", "n_echo_words", "n_words", 1000, False, 3, 20),
)
RANKS = (750, 800, 850, 900, 925, 950, 970, 980, 990, 995)  # of 1000, from a quartile outwards
ORIGIN = 250  # the rank of the other quartile
LEAP = 2  # times the distance from there that the next rank's quantile may have
MIN_DOCS = 50  # of a group that has thresholds of its own
SALTS = 16  # parts of a hot group in the join with thresholds


def repeated(codes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Whether a value occurs twice or more with the same owner."""
    key = pa.array((owner.astype(np.int64) << 32) | codes).dictionary_encode()
    index = key.indices.to_numpy()
    return (np.bincount(index) > 1)[index] if len(index) else np.zeros(0, bool)


def numbered(pairs: np.ndarray) -> np.ndarray:
    return pa.array(pairs).dictionary_encode().indices.to_numpy().astype(np.int64)


def repeat_words(code: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """For n texts, how many words lie in windows of WINDOW words that occur twice or more in the text.

    Equal windows get equal numbers by numbering pairs of words, then pairs of pairs: exact, no hashing.
    """
    out = np.zeros(n, np.int64)
    if len(code) < WINDOW:
        return out
    code, step = code.astype(np.int64), 1
    while step < WINDOW:
        code = numbered((code[:-step] << 32) | code[step:])
        step *= 2
    starts = np.flatnonzero(owner[: len(code)] == owner[WINDOW - 1 :])
    hit = starts[repeated(code[starts], owner[starts])]
    edge = np.zeros(len(owner) + 1, np.int64)
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + WINDOW, -1)
    covered = np.cumsum(edge[:-1]) > 0
    return np.bincount(owner[covered], minlength=n).astype(np.int64)


def text_counts(texts: pa.Array) -> list[np.ndarray]:
    """COUNTS for each text; an echo is a word equal to the one before it."""
    n = len(texts)
    off, words = pieces(pc.ascii_split_whitespace(texts))
    owner = np.repeat(np.arange(n), np.diff(off))
    real = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)  # white space at an end leaves an empty one
    words, owner = words.filter(pa.array(real)), owner[real]
    coded = words.dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False)
    chars = pc.utf8_length(coded.dictionary).to_numpy(zero_copy_only=False).astype(np.int64)
    loff, lines = pieces(pc.split_pattern(texts, pattern="\n"))
    lowner = np.repeat(np.arange(n), np.diff(loff))
    lcoded = lines.dictionary_encode()
    lcode = lcoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    worded = pc.match_substring_regex(lcoded.dictionary, r"[^\x20\x09-\x0D]").to_numpy(zero_copy_only=False)
    keep = worded[lcode] if len(lcode) else np.zeros(0, bool)
    lcode, lowner = lcode[keep], lowner[keep]
    all_lines = np.bincount(lowner, minlength=n)
    pairs = np.unique((lowner << 32) | lcode)
    return [
        np.bincount(owner, minlength=n),
        np.bincount(owner, chars[code], minlength=n).astype(np.int64) if len(code) else np.zeros(n, np.int64),
        sum(pc.count_substring(texts, pattern=s).to_numpy().astype(np.int64) for s in SYMBOLS),
        all_lines - np.bincount(pairs >> 32, minlength=n),
        repeat_words(code, owner, n),
        np.bincount(owner[1:][(code[1:] == code[:-1]) & (owner[1:] == owner[:-1])], minlength=n),
    ]


def measure(docs: DataFrame, key: str = "doc_id", text: str = "text", others: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """Key, other columns and COUNTS of every text; a null text has no words."""
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in (key, *others)) + "".join(f", {c} bigint" for c in COUNTS)

    def run(batches):
        for part in slices(batches, text):
            found = text_counts(filled(part, text))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in (key, *others)), *(pa.array(x, pa.int64()) for x in found)], [key, *others, *COUNTS])

    return docs.select(*dict.fromkeys((key, *others, text))).mapInArrow(run, schema)


def to_bin(v: Column) -> Column:
    """A value's bin: exact below 64, then 32 bins to an octave."""
    e = F.greatest(F.length(F.bin(v)) - 6, F.lit(0))
    return (e * 32 + F.floor(v / F.pow(F.lit(2.0), e))).cast("long")


def bin_floor(b: Column) -> Column:
    """The least value of a bin."""
    e = F.when(b < 64, F.lit(0)).otherwise(F.floor(b / 32) - 1)
    return ((b - e * 32) * F.pow(F.lit(2.0), e)).cast("long")


def bin_top(b: Column) -> Column:
    """The greatest value of a bin."""
    return bin_floor(b + 1) - 1


def ratio(a: str | Column, b: str, scale: int) -> Column:
    """In whole parts of 1 / scale; the denominator is only 0 where the fixed rules fail."""
    return F.floor((F.col(a) if isinstance(a, str) else a) * scale / F.greatest(F.col(b), F.lit(1))).cast("long")


def sketch(measured: DataFrame, groups: tuple[str, ...]) -> DataFrame:
    """Bin counts per group and ratio, of the documents that pass the fixed rules."""
    values = F.array(*(F.struct(F.lit(name).alias("ratio"), to_bin(ratio(a, b, scale)).alias("bin")) for name, a, b, scale, _, _, _ in RATIOS))
    return measured.where(~F.col("base_failed")).select(*groups, F.explode(values).alias("v")).groupBy(*groups, "v.ratio", "v.bin").agg(F.count("*").alias("n"))


def merge(sketches: DataFrame, groups: tuple[str, ...]) -> DataFrame:
    return sketches.groupBy(*groups, "ratio", "bin").agg(F.sum("n").alias("n"))


def fences(sketches: DataFrame, groups: tuple[str, ...]) -> DataFrame:
    """A row per group and ratio: ``docs``, and the fences ``low`` and ``high``."""
    by = Window.partitionBy(*groups, "ratio")
    ranked = sketches.withColumn("upto", F.sum("n").over(by.orderBy("bin"))).withColumn("docs", F.sum("n").over(by))
    at = lambda rank, value: F.min(F.when(F.col("upto") * 1000 >= F.col("docs") * rank, value(F.col("bin"))))
    quantiles = [c for r in (ORIGIN, *RANKS) for c in (at(r, bin_top).alias(f"u{r}"), at(1000 - r, bin_floor).alias(f"d{r}"))]
    found = ranked.groupBy(*groups, "ratio").agg(F.max("docs").alias("docs"), *quantiles)
    step = F.create_map(*(F.lit(x) for name, *_, least in RATIOS for x in (name, least)))[F.col("ratio")]
    below = F.col("ratio").isin(*(name for name, _, _, _, low, _, _ in RATIOS if low))

    def fence(side: str, sign: int, nearer) -> Column:
        away = lambda r: (F.col(f"{side}{r}") - F.col(f"{side}{ORIGIN}")) * sign
        leaps = [F.when(away(r) > away(q) * LEAP + step, F.col(f"{side}{q}")) for q, r in zip(RANKS, RANKS[1:])]
        return nearer(F.col(f"{side}{RANKS[-1]}"), *leaps)

    low = F.when(below, fence("d", -1, F.greatest)).otherwise(F.lit(-1))
    return found.select(*groups, "ratio", "docs", low.alias("low"), fence("u", 1, F.least).alias("high"))


def thresholds(measured: DataFrame, groups: tuple[str, str] = ("lang", "source"), min_docs: int = MIN_DOCS) -> DataFrame:
    """A row per group: the fences of each ratio, from the group's own sketch or a merged one."""
    lang, source = groups
    own = sketch(measured, groups).select(F.lit(2).alias("level"), F.col(lang).alias("_l"), F.col(source).alias("_s"), "ratio", "bin", "n")
    # sketches of a language and of everything are the sums of the groups' ones
    wider = own.select(F.explode(F.array(F.lit(1), F.lit(0))).alias("level"), "_l", F.lit(None).cast(own.schema["_s"].dataType).alias("_s"), "ratio", "bin", "n")
    wider = wider.withColumn("_l", F.when(F.col("level") == 1, F.col("_l")))
    by = ("level", "_l", "_s")
    found = fences(own.unionByName(merge(wider, by).select(own.columns)), by)
    cells = [F.max(F.when(F.col("ratio") == name, F.col(side))).alias(f"{name}_{side}") for name, *_ in RATIOS for side in ("low", "high")]
    limits = found.groupBy(*by).agg(F.max("docs").alias("docs"), F.struct(*cells).alias("fence")).alias("o")
    up = lambda level, name: limits.where(F.col("level") == level).select(F.col("_l").alias(f"{name}_l"), F.col("docs").alias(f"{name}_docs"), F.col("fence").alias(f"{name}_fence"))
    joined = limits.where("level = 2").join(up(1, "b"), F.col("o._l").eqNullSafe(F.col("b_l"))).join(up(0, "a"), F.lit(True))
    chosen = F.when(F.col("o.docs") >= min_docs, F.col("o.fence")).when(F.col("b_docs") >= min_docs, F.col("b_fence")).otherwise(F.col("a_fence"))
    return joined.select(F.col("o._l").alias(lang), F.col("o._s").alias(source), chosen.alias("fence")).select(lang, source, "fence.*")


def quality_rules(docs: DataFrame, key: str = "doc_id", text: str = "text", groups: tuple[str, str] = ("lang", "source"), min_docs: int = MIN_DOCS, also: tuple[str, ...] = ()) -> DataFrame:
    """Counts and verdict of every document: key, groups, columns ``also``, COUNTS, ``base_failed`` and ``kept``.

    A document fails the fixed rules with under 20 words, or with over 30 % of its words in windows
    of 8 words that it repeats.  Of the others, those are kept whose ratios lie within the fences of
    their (lang, source), or beyond them by a few events.

    null text: no words, so ``base_failed``.  null lang or source: a group of its own.  Empty text:
    as null.  Ties at a fence are kept.  Repeated rows each count and each give a row.  Columns
    beside those named aren't read.  Empty table: empty result.
    """
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    measured = materialise(measure(docs, key, text, (*groups, *also)).withColumn("base_failed", failed), "quality")
    limits = materialise(thresholds(measured, groups, min_docs), "fences").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    limits = limits.select(*(F.col(c).alias(f"t_{c}") for c in limits.columns))
    on = F.col("salt") == F.col("t_salt")
    for c in groups:
        on = on & F.col(c).eqNullSafe(F.col(f"t_{c}"))
    salted = measured.withColumn("salt", F.pmod(F.hash(key, *COUNTS), F.lit(SALTS)))
    within = ~F.col("base_failed")
    for name, a, b, scale, low, events, _ in RATIOS:
        within = within & (ratio(F.greatest(F.col(a) - events, F.lit(0)), b, scale) <= F.col(f"t_{name}_high"))
        if low:
            within = within & (ratio(F.col(a) + events, b, scale) >= F.col(f"t_{name}_low"))
    return salted.join(limits, on, "left").select(key, *groups, *also, *COUNTS, "base_failed", F.coalesce(within, F.lit(False)).alias("kept"))


def keep_good(docs: DataFrame, key: str = "doc_id", text: str = "text", groups: tuple[str, str] = ("lang", "source")) -> DataFrame:
    """The documents that are kept, with all their columns.  Nulls and repeats as in ``quality_rules``.

    The texts are written once beside their counts and stay dealt out as they are; only counts are shuffled.
    """
    place = {c: f"c{i}" for i, c in enumerate(docs.columns)}  # names that can't clash
    plain = docs.select(*(docs[c].alias(p) for c, p in place.items()))
    named = (place[groups[0]], place[groups[1]])
    also = tuple(p for c, p in place.items() if c not in (key, *groups))
    good = quality_rules(plain, place[key], place[text], named, also=also).where("kept")
    return good.select(*(F.col(p).alias(c) for c, p in place.items()))
