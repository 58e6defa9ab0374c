"""Spelling variants of a corpus vocabulary, grouped under their frequent forms.

*Words* are maximal runs of letters, counted with map-side sums; only a word
and its count leave a task.

*Trie numbers.*  The distinct words are dealt into ranges of their sorted order.
In a range a word shares its trie nodes with the word before it up to their
common prefix and gets fresh numbers for the rest, so one pass numbers all
prefixes.  A node that words of several ranges share is a prefix of a range's
lower bound: those few have numbers of their own, known to every range.  The
reversed words are numbered alike, which numbers all suffixes.

*Neighbours.*  A word split at a position is a pair of integers: (prefix node,
suffix node) with nothing between them, or with one letter skipped.  Two words
with the same pair and a skipped letter in each differ in that letter; a pair
with a skipped letter on one side only is an insertion or deletion.  The pairs
are joined; a pair names both strings exactly, so no candidate has to be
confirmed, and it has at most one word for each letter.  Of equal letters in a
row only the first counts as inserted, so a pair of words comes once.

*Roots.*  Forms lead to words at least ``ratio`` times as frequent, so they have
no cycles; they are followed by pointer doubling until nothing changes.

Defined results: null and empty texts have no words; a null id is written as
an empty string before the colon; rows with repeated ids count like others; of
equally frequent near words the smallest in code-point order is the form; an
empty table gives no words; other columns are not read.  A run of letters may be
as long as its text: a word of n letters takes n rows, never n^2 bytes.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.llm.common import ascii_lower, settled, small_batches, written


@dataclass(frozen=True)
class VariantConfig:
    least_length: int = 6        # code points of a word
    least_count: int = 5         # occurrences of a word
    ratio: int = 5               # a form is at least so many times as frequent
    divisor: int = 199           # one run in so many loses a letter; 0: none
    range_words: int = 100_000   # words of one range, about
    bound_letters: int = 256     # letters of a range's lower bound at most


#: Fixed value: the letters of a word.
RUN = "[A-Za-zÀ-ÿ]+"
#: sample words for each range's bound; they decide where ranges end, and no result
SAMPLE = 32


def damaged(run: Column, doc_id: Column, divisor: int) -> Column:
    """A run that loses one code point when the divisor divides its checksum."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run))
    at = (h % F.char_length(run)).cast("int")
    cut = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))
    return F.when(h % divisor == 0, cut).otherwise(run)


def word_counts(docs: DataFrame, cfg: VariantConfig = VariantConfig(), id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n) of the words long and frequent enough."""
    runs = docs.select(F.col(f"`{id_col}`").alias("id"), F.explode(F.regexp_extract_all(
        F.col(f"`{text}`").cast("string"), F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.where(F.char_length("run") >= cfg.least_length).select("id", ascii_lower(F.col("run")).alias("run"))
    word = damaged(F.col("run"), F.col("id"), cfg.divisor) if cfg.divisor else F.col("run")
    words = runs.select(word.alias("word")).where(F.char_length("word") >= cfg.least_length)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= cfg.least_count)


def range_bounds(words: DataFrame, ranges: int, value: Column, letters: int) -> list[str]:
    """Lower bounds of all ranges but the first, from a hashed sample of words."""
    if ranges < 2:
        return []
    some = words.orderBy(F.xxhash64("word"), "word").limit(SAMPLE * ranges).select(F.substring(value, 1, letters).alias("v"))
    held = sorted(r.v for r in some.collect())
    return sorted({held[len(held) * k // ranges] for k in range(1, ranges)} if held else set())


def trie_numbers(strings: list[str], shared: dict[str, int], base: int) -> list[list[int]]:
    """Node numbers of all prefixes of sorted strings, the empty one first.
    Prefixes in ``shared`` keep their numbers; others count up from ``base``."""
    out, before, path, known = [], "", [shared[""]], 0
    for s in strings:
        same, most = 0, min(len(s), len(before))
        while same < most and s[same] == before[same]:
            same += 1
        path = path[:same + 1]
        known = min(known, same)
        for d in range(same + 1, len(s) + 1):
            if known == d - 1 and s[:d] in shared:
                known = d
                path.append(shared[s[:d]])
            else:
                path.append(base)
                base += 1
        out.append(path)
        before = s
    return out


def _in_ranges(bounds: list[str], reverse: bool):
    def run(batches):
        import pyarrow as pa
        for b in batches:
            word = [w[::-1] if reverse else w for w in b.column("word").to_pylist()]
            yield b.append_column("part", pa.array([bisect_right(bounds, w) for w in word], pa.int64()))
    return run


def _number(bounds: list[str], reverse: bool):
    shared = {p: i for i, p in enumerate(sorted({"", *(b[:d] for b in bounds for d in range(1, len(b) + 1))}))}

    def run(t):
        import numpy as np
        import pyarrow as pa
        words = t.column("word").to_pylist()
        keys = [w[::-1] for w in words] if reverse else words
        order = sorted(range(len(keys)), key=keys.__getitem__)
        t = t.take(pa.array(order, pa.int64()))
        part = t.column("part")[0].as_py()
        numbers = trie_numbers([keys[i] for i in order], shared, (part + 1) << 36)
        at = np.r_[0, np.cumsum([len(x) for x in numbers])]
        nodes = pa.LargeListArray.from_arrays(pa.array(at, pa.int64()), pa.array(np.concatenate(numbers), pa.int64())).cast(pa.list_(pa.int64()))
        if reverse:
            return t.drop_columns(["part"]).append_column("after", nodes)
        fresh = [[i == 0 or w[i] != w[i - 1] for i in range(len(w))] for w in (words[i] for i in order)]
        rank = pa.array((part << 32) + np.arange(len(words)), pa.int64())              # the order of words
        return (t.drop_columns(["part"]).append_column("rank", rank).append_column("fresh", pa.array(fresh, pa.list_(pa.bool_())))
                .append_column("before", nodes))
    return run


def trie_pairs(words: DataFrame, cfg: VariantConfig = VariantConfig()) -> DataFrame:
    """(word, n, rank, fresh, before, after): ranks follow code-point order,
    ``before[i]`` is the node of the first i letters, ``after[i]`` that of the last."""
    small_batches(words.sparkSession, 4096)
    ranges = max(1, -(-words.count() // cfg.range_words))
    schema = "word string, n long"
    for reverse in (False, True):
        bounds = range_bounds(words, ranges, F.reverse("word") if reverse else F.col("word"), cfg.bound_letters)
        dealt = words.mapInArrow(_in_ranges(bounds, reverse), schema + ", part long")
        schema += ", after array<long>" if reverse else ", rank long, fresh array<boolean>, before array<long>"
        words = settled(dealt.groupBy("part").applyInArrow(_number(bounds, reverse), schema))
    return words


def near_pairs(numbered: DataFrame) -> DataFrame:
    """(rank, near, near_n): every two words at one inserted, deleted or replaced
    code point, in both directions, each once."""
    size = F.size("fresh")
    half = lambda i: F.floor(i / 2).cast("int")
    at = F.explode(F.transform(F.sequence(F.lit(0), 2 * size), lambda i: F.struct(
        F.get("before", half(i)).alias("p"), F.get("after", size - half(i + 1)).alias("s"),
        (i % 2 == 1).alias("skip"), ((i % 2 == 1) & F.get("fresh", half(i))).alias("first"))))
    split = numbered.select("rank", "n", at.alias("x")).select("rank", "n", "x.*")
    long = split.where("skip").select("p", "s", "first", F.col("rank").alias("a"), F.col("n").alias("a_n"))
    other = split.select("p", "s", "skip", F.col("rank").alias("b"), F.col("n").alias("b_n"))
    met = long.join(other, ["p", "s"]).where("a <> b and (skip or first)")
    both = F.when(F.col("skip"), F.array(F.struct(F.col("a").alias("rank"), F.col("b").alias("near"), F.col("b_n").alias("near_n")))).otherwise(
        F.array(F.struct(F.col("a").alias("rank"), F.col("b").alias("near"), F.col("b_n").alias("near_n")),
                F.struct(F.col("b").alias("rank"), F.col("a").alias("near"), F.col("a_n").alias("near_n"))))
    return met.select(F.explode(both).alias("x")).select("x.*")


def roots(forms: DataFrame) -> DataFrame:
    """(rank, form, root) of (rank, form): forms followed to the last one."""
    now = settled(forms.select("rank", "form", F.col("form").alias("root")))
    while True:
        step = now.select(F.col("rank").alias("_r"), F.col("root").alias("_next"))
        moved = now.join(step, F.col("root") == F.col("_r"), "left")
        after = settled(moved.select("rank", "form", F.coalesce("_next", "root").alias("root"), F.col("_r").isNotNull().alias("moved")))
        now = after.drop("moved")
        if after.where("moved").isEmpty():
            return now


def spelling_variants(docs: DataFrame, cfg: VariantConfig = VariantConfig(), id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of the corpus."""
    numbered = trie_pairs(settled(word_counts(docs, cfg, id_col, text)), cfg)
    words = written(numbered.select("rank", "word", "n"), "variants-words")
    near = near_pairs(numbered).groupBy("rank").agg(
        F.count(F.lit(1)).alias("n_near"), F.max(F.struct("near_n", (-F.col("near")).alias("minus"))).alias("best"))
    near = written(near.select("rank", "n_near", (-F.col("best.minus")).alias("form"), F.col("best.near_n").alias("form_n")), "variants-near")
    forms = words.join(near, "rank").where(F.col("form_n") >= cfg.ratio * F.col("n")).select("rank", "form", "form_n")
    forms = written(forms, "variants-forms")
    ends = roots(forms)
    name = lambda c: words.select(F.col("rank").alias(c), F.col("word").alias(f"{c}_word"))
    led = (forms.join(ends.select("rank", "root"), "rank").join(name("form"), "form").join(name("root"), "root")
           .select("rank", F.col("form_word").alias("form"), F.col("root_word").alias("root"), "form_n"))
    out = words.join(near.select("rank", "n_near"), "rank", "left").join(led, "rank", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
