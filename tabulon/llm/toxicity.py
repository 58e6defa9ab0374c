"""Toxic passages by maximum-scoring segments of token log-odds.

1. *Lexicon* (Spark): from labelled documents, the log-odds of every unit
   between toxic and clean documents under an informative Dirichlet prior (the
   prior of a unit is its share of the whole sample), with its z-score.  A unit
   is a word or the first 4, 5 or 6 letters of a longer word, so inflected and
   compounded forms of one stem are learnt together.  Units with ``|z|`` of at
   least ``min_z`` and log-odds of at least ``min_log_odds`` are kept, at most
   ``max_units`` (the model's stated size).
2. *Segments*: a text is a sequence of token scores; a token takes the log-odds
   of its most certain unit, or the small negative ``background``.  One linear
   scan (stack of candidates over running sums) finds all maximal-scoring
   segments.  Only positive tokens can begin or end one, so the runs between
   them enter as single sums.
3. *Calibration*: the null rate of segments follows the extreme-value law
   ``E = K n exp(-lambda S)``.  ``lambda`` solves ``sum p e^(lambda s) = 1`` on
   the clean token scores, ``K`` is counted on clean documents.  The normalised
   scores ``lambda S - ln(K n)`` of the segments with ``E <= sum_e`` are summed
   per document, and a one-variable logistic fit on labelled documents that did
   not build the lexicon gives the score.  Only a segment with ``E <= max_e`` is
   significant, that is, reported as a passage.

The labelled rows are a sample bounded by ``max_labelled`` (smallest hashes of
the id); every document is scored whole.  What is broadcast is the lexicon, at
most ``max_units`` rows.

Defined results: a null or empty text has no segment and gets the calibrated
score of such documents; without labels of both classes the lexicon is empty
and every score is 0; repeated labels of one id count once (toxic wins), null
labels and ids are skipped; of teachers of one label that share at least 0.8 of
their five-word shingles (estimated) the smallest id teaches.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field
from typing import Iterable, Iterator, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.llm.common import no_clash, settled, small_batches


@dataclass(frozen=True)
class ToxicityConfig:
    max_labelled: int = 30_000     # labelled documents that teach
    min_z: float = 2.8             # certainty of a lexicon unit
    min_log_odds: float = 1.5      # a weaker unit says nothing about a passage
    min_documents: int = 3         # documents a unit must occur in
    prior_share: float = 0.1       # pseudo-documents of the Dirichlet prior, as a share of the teachers
    background: float = -0.15      # score of a token without a lexicon unit
    sum_e: float = 1.0             # expected null segments at a score that counts for the document
    max_e: float = 0.002           # expected null segments at a significant score (a reported passage)
    cache_entries: int = 200_000


@dataclass
class ToxicityModel:
    """The fitted lexicon and the calibration constants."""
    units: dict[str, tuple[float, float]]      # unit -> (log-odds, |z|)
    config: ToxicityConfig
    lam: float = 1.0
    k: float = 0.1
    weight: float = 0.0                        # logistic: weight * T + bias
    bias: float = -50.0
    bins: list = field(default_factory=list)

    def probability(self, t: float) -> float:
        x = max(-60.0, min(60.0, self.weight * t + self.bias))
        return 1.0 / (1.0 + math.exp(-x))


_WORD = re.compile(r"[^\W\d_]+").findall
_PREFIXES = (4, 5, 6)


def units_of(word: str) -> list[str]:
    """The word (marked as whole) and its proper prefixes."""
    return ["=" + word] + [word[:n] for n in _PREFIXES if len(word) > n]


class TokenScores(dict):
    """Scores of chunks (runs without white space), kept for repeated chunks."""

    def __init__(self, units: dict[str, tuple[float, float]], background: float, entries: int):
        super().__init__()
        self.units, self.background, self.entries = units, background, entries

    def __missing__(self, chunk: str) -> float:
        best = None
        for w in _WORD(chunk):
            known = [self.units[u] for u in units_of(w) if u in self.units]
            if known:
                s = max(known, key=lambda x: x[1])[0]
                best = s if best is None else max(best, s)
        s = self.background if best is None else best
        if len(chunk) <= 64:
            if len(self) >= self.entries:
                self.clear()
            self[chunk] = s
        return s


def maximal_segments(scores) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end, sum), end exclusive, in linear time.

    Each positive token opens a candidate, which merges leftwards while the nearest
    earlier candidate with a smaller left sum has a smaller right sum too.  A
    candidate keeps a link to that earlier one; candidates that a search passes over
    lie behind the new one's link and are not looked at again."""
    import numpy as np
    s = np.asarray(scores, dtype=np.float64)
    hot = np.flatnonzero(s > 0)
    if not len(hot):
        return []
    run = np.cumsum(s)
    right = run[hot].tolist()
    left = (run[hot] - s[hot]).tolist()
    kept: list[tuple[int, int, float, float, int]] = []   # start, end, sum before, sum through, link
    for i, before, through in zip(hot.tolist(), left, right):
        begin, j = i, len(kept) - 1
        while True:
            while j >= 0 and kept[j][2] >= before:
                j = kept[j][4]
            if j < 0 or kept[j][3] >= through:
                break
            begin, _, before, _, link = kept[j]
            del kept[j:]
            j = link
        kept.append((begin, i + 1, before, through, j))
    return [(a, b, r - l) for a, b, l, r, _ in kept]


def segments_of(text: str, table: TokenScores) -> tuple[int, list[tuple[int, int, float]]]:
    import numpy as np
    chunks = text.lower().split()
    if not chunks:
        return 0, []
    return len(chunks), maximal_segments(np.fromiter(map(table.__getitem__, chunks), np.float64, len(chunks)))


def normalised(n: int, segments, model: ToxicityModel) -> list[tuple[int, int, float]]:
    """(start, end, normalised score) of the segments that pass ``sum_e``."""
    floor = -math.log(model.config.sum_e)
    base = math.log(model.k * max(n, 1))
    out = [(a, b, model.lam * s - base) for a, b, s in segments]
    return [x for x in out if x[2] >= floor]


def significant(segments, model: ToxicityModel) -> list[tuple[int, int, float]]:
    """Those of the normalised segments that pass ``max_e``."""
    floor = -math.log(model.config.max_e)
    return [x for x in segments if x[2] >= floor]


def _teachers(docs: DataFrame, labels: DataFrame, cfg: ToxicityConfig, id_col: str, text: str, label: str) -> DataFrame:
    """A bounded, deterministic sample of labelled documents without near-copies."""
    lab = (labels.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{label}`").cast("int").alias("_toxic"))
           .dropna().groupBy("_id").agg(F.max("_toxic").alias("_toxic"))
           .where(F.crc32(F.col("_id").cast("string")) % 5 != 0)
           .orderBy(F.xxhash64("_id"), "_id").limit(cfg.max_labelled))
    d = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text}`").cast("string").alias("_text")).where("_text is not null")
    rows = d.join(F.broadcast(lab), "_id").mapInArrow(_sketched, "_id string, _text string, _toxic int, _k array<long>")  # at most max_labelled ids
    rows = settled(rows.withColumn("_n", F.monotonically_increasing_id()))
    return rows.join(F.broadcast(_repeats(rows)), "_n", "left_anti").select(
        "_text", "_toxic", (F.crc32("_id") % 5 == 4).alias("_check"))


#: minima by which near-copies among the teachers are recognised: in bands that
#: propose pairs, and all together as an estimate of their similarity
_BANDS, _ROWS, _ALIKE = 12, 5, 0.8


def _repeats(rows: DataFrame) -> DataFrame:
    """_n of the teachers that are near-copies of a smaller one of the same label
    (they would teach every word of theirs again); the smallest of a group stays."""
    order = F.struct("_id", F.xxhash64("_text").alias("_h"), "_n")
    bands = F.array(*[F.xxhash64(F.slice("_k", 1 + i * _ROWS, _ROWS)) for i in range(_BANDS)])
    keys = rows.select("_n", "_toxic", order.alias("_o"), F.posexplode(bands).alias("_b", "_v"))
    first = keys.groupBy("_b", "_v", "_toxic").agg(F.min("_o").alias("_m"), F.count(F.lit(1)).alias("_c")).where("_c > 1")
    pairs = keys.join(first.select("_b", "_v", "_toxic", F.col("_m._n").alias("_f")), ["_b", "_v", "_toxic"])
    pairs = pairs.where("_n <> _f").select("_n", "_f").distinct()
    both = pairs.join(rows.select("_n", "_k"), "_n").join(rows.select(F.col("_n").alias("_f"), F.col("_k").alias("_l")), "_f")
    same = F.aggregate(F.zip_with("_k", "_l", lambda a, b: (a == b).cast("int")), F.lit(0), lambda a, v: a + v)
    return both.where(same >= _ALIKE * _BANDS * _ROWS).select("_n").distinct()


def _sketched(batches: Iterable) -> Iterator:
    import pyarrow as pa
    from tabulon.llm.near_copies import MinHashConfig, Minima, shingle_set
    minima = Minima(MinHashConfig(bands=_BANDS, rows=_ROWS))
    for b in batches:
        keys = []
        for x in b.column(1):
            s = shingle_set(x.as_py(), 5)
            keys.append(minima.of(s).astype("int64").tolist() if len(s) else [-1] * (_BANDS * _ROWS))
        yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.string()), b.column(1), b.column(2), pa.array(keys, pa.list_(pa.int64()))],
                                         names=["_id", "_text", "_toxic", "_k"])


def _unit_counts(batches: Iterable) -> Iterator:
    import pyarrow as pa
    schema = pa.schema([("unit", pa.string()), ("toxic", pa.int64()), ("clean", pa.int64())])
    counts = (Counter(), Counter())

    def rows():
        names = list(counts[0].keys() | counts[1].keys())
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([counts[1][u] for u in names], pa.int64()),
                                           pa.array([counts[0][u] for u in names], pa.int64())], schema=schema)
    for b in batches:
        for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            seen = set()
            for w in set(_WORD(text.lower())):
                seen.update(units_of(w))
            counts[1 if toxic else 0].update(seen)
        if len(counts[0]) + len(counts[1]) > 300_000:     # bounded memory: hand over and go on
            yield rows()
            counts[0].clear(), counts[1].clear()
    yield rows()


def _lexicon(train: DataFrame, cfg: ToxicityConfig) -> tuple[dict, list]:
    per = train.select("_text", "_toxic").mapInArrow(_unit_counts, "unit string, toxic long, clean long")
    counts = per.groupBy("unit").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c")).where(
        F.col("t") + F.col("c") >= cfg.min_documents)
    n = train.groupBy().agg(F.sum("_toxic").alias("nt"), F.sum(1 - F.col("_toxic")).alias("nc")).first()
    nt, nc = int(n["nt"] or 0), int(n["nc"] or 0)
    if not nt or not nc:
        return {}, []
    # documents with and without the unit, each side with the prior's pseudo-documents
    weight = cfg.prior_share * (nt + nc)
    a = F.lit(weight) * (F.col("t") + F.col("c")) / F.lit(float(nt + nc))
    yt, yc = F.col("t") + a, F.col("c") + a
    rest_t, rest_c = F.lit(nt + weight) - yt, F.lit(nc + weight) - yc
    delta = F.log(yt / rest_t) - F.log(yc / rest_c)
    z = delta / F.sqrt(1 / yt + 1 / yc)
    # a unit in almost every document says nothing and has no finite odds
    kept = (counts.where((rest_t > 0) & (rest_c > 0)).select("unit", "t", "c", delta.alias("d"), z.alias("z"))
            .where((F.abs("z") >= cfg.min_z) & (F.abs("d") >= cfg.min_log_odds)))
    rows = kept.collect()                                # units of at most max_labelled documents
    return {r["unit"]: (float(r["d"]), abs(float(r["z"]))) for r in rows}, [nt, nc]


def _raw_segments(model: ToxicityModel):
    """Per labelled document: tokens, segment scores; and counted token scores."""
    def run(batches):
        import pyarrow as pa
        scores = TokenScores(model.units, model.config.background, model.config.cache_entries)
        for b in batches:
            out = []
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                n, seg = segments_of(text, scores)
                out.append({"toxic": toxic, "n": n, "seg": [s for _, _, s in seg],
                            "hot": [round(scores[c], 2) for c in text.lower().split() if scores[c] != model.config.background]
                            if not toxic else []})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([
                ("toxic", pa.int32()), ("n", pa.int64()), ("seg", pa.list_(pa.float64())), ("hot", pa.list_(pa.float64()))]))
    return run


def _solve_lambda(freq: list[tuple[float, float]]) -> float:
    """The positive root of sum p e^(lambda s) = 1 (scores have a negative mean)."""
    f = lambda x: sum(p * math.exp(min(x * s, 700.0)) for s, p in freq) - 1.0
    lo, hi = 1e-6, 1.0
    while f(hi) < 0 and hi < 64:
        hi *= 2
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    return (lo + hi) / 2


def fit_toxicity(docs: DataFrame, labels: DataFrame, cfg: ToxicityConfig = ToxicityConfig(), id_col: str = "doc_id",
                 text: str = "text", label: str = "toxic") -> ToxicityModel:
    small_batches(docs.sparkSession)
    sample = settled(_teachers(docs, labels, cfg, id_col, text, label))
    units, n = _lexicon(sample.where(~F.col("_check")), cfg)
    model = ToxicityModel(units, cfg)
    if not units:
        return model
    seg = settled(sample.mapInArrow(_scored(model), "toxic int, n long, seg array<double>, hot array<double>, check boolean"))
    clean = seg.where("toxic = 0")
    total = clean.agg(F.sum("n").alias("n")).first()["n"] or 0
    hot = clean.select(F.explode("hot").alias("s")).groupBy("s").count().collect()   # scores rounded to 0.01: bounded
    freq = [(float(r["s"]), r["count"] / max(total, 1)) for r in hot]
    best = max(s for s, _ in units.values())
    freq += [(best, 0.5 / max(total, 1)), (cfg.background, max(0.0, 1.0 - sum(p for _, p in freq)))]
    mean = sum(s * p for s, p in freq)
    model.lam = _solve_lambda(freq) if mean < 0 else 0.1
    # segments of clean documents at or above a mid-range score: Poisson(K N e^(-lambda s))
    s0 = best / 2
    found = clean.select(F.explode("seg").alias("s")).where(F.col("s") >= s0).count()
    model.k = (found + 0.5) / (max(total, 1) * math.exp(-model.lam * s0))
    _calibrate(model, seg)
    return model


def _scored(model: ToxicityModel):
    raw = _raw_segments(model)

    def run(batches):
        import pyarrow as pa
        for b in batches:
            for out in raw([b]):
                yield pa.RecordBatch.from_arrays([*out.columns, b.column(2)], names=[*out.schema.names, "check"])
    return run


def _statistic(model: ToxicityModel) -> F.Column:
    """Sum of the normalised scores of the segments that count, in Spark."""
    base = F.log(F.lit(model.k) * F.greatest("n", F.lit(1)))
    x = F.transform("seg", lambda s: F.lit(model.lam) * s - base)
    return F.aggregate(F.filter(x, lambda v: v >= -math.log(model.config.sum_e)), F.lit(0.0), lambda a, v: a + v)


#: Where the logistic fit starts and, with few documents, stays: even odds at a
#: statistic of 9, about one clear word in a text of ordinary length.
_LOGISTIC_PRIOR = (0.55, -5.0)


def _calibrate(model: ToxicityModel, seg: DataFrame) -> None:
    """Logistic fit of the label on the statistic, in bins of a half."""
    both = seg.groupBy("check").agg(F.countDistinct("toxic").alias("k")).where("check and k = 2").count()
    d = seg.where("check") if both else seg
    bins = (d.select(F.floor(_statistic(model) * 2).alias("b"), "toxic").groupBy("b")
            .agg(F.sum("toxic").alias("t"), F.count(F.lit(1)).alias("n")).collect())
    pts = [(r["b"] / 2.0, float(r["t"]), float(r["n"])) for r in bins]
    w, b, ridge = *_LOGISTIC_PRIOR, 1.0
    w0, b0 = _LOGISTIC_PRIOR
    softplus = lambda z: max(z, 0.0) + math.log1p(math.exp(-abs(z)))

    def loss(w, b):                            # half a pseudo-row of each class keeps separable data finite
        return (sum((n + 1 / len(pts)) * softplus(w * x + b) - (t + 0.5 / len(pts)) * (w * x + b) for x, t, n in pts)
                + ridge / 2 * ((w - w0) ** 2 + (b - b0) ** 2))
    for _ in range(1000):                      # Newton steps of a convex fit in two parameters
        gw = gb = hww = hwb = hbb = 0.0
        for x, t, n in pts:
            p = 1 / (1 + math.exp(-max(-40.0, min(40.0, w * x + b))))
            g, h = (n * p - t) + (p - 0.5) / len(pts), (n + 1 / len(pts)) * p * (1 - p)
            gw, gb = gw + g * x, gb + g
            hww, hwb, hbb = hww + h * x * x, hwb + h * x, hbb + h
        gw, gb, hww, hbb = gw + ridge * (w - w0), gb + ridge * (b - b0), hww + ridge, hbb + ridge
        det = hww * hbb - hwb * hwb
        dw, db = (hbb * gw - hwb * gb) / det, (hww * gb - hwb * gw) / det
        fall, now, step = gw * dw + gb * db, loss(w, b), 1.0
        if fall < 1e-12 * max(1.0, abs(now)):
            break
        while loss(w - step * dw, b - step * db) > now - 1e-4 * step * fall and step > 1e-9:
            step /= 2
        w, b = w - step * dw, b - step * db
    else:
        raise ArithmeticError("the calibration did not converge")
    model.weight, model.bias, model.bins = w, b, pts


def score_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text", keep: Sequence[str] = (),
                   passages: bool = False, verdict: str | None = None) -> DataFrame:
    """``keep`` columns plus score, predicted and n_passages for every row; with
    ``passages`` also the significant segments (token start, end, score).  With
    ``verdict`` only the prediction is added, under that name, so that no column
    of ``keep`` can clash."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    src = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("_text"))
    passage = T.StructType().add("begin", T.IntegerType()).add("end", T.IntegerType()).add("score", T.DoubleType())
    # names of the added columns; with ``verdict`` they are out of the way of ``keep``
    no_clash(keep, "_text", *([verdict] if verdict else ["score", "n_passages", "passages", "predicted"]))
    names = [f"{verdict}_{x}" if verdict else x for x in ("score", "n_passages", "passages")]
    out = src.drop("_text").schema.add(names[0], T.DoubleType(), False).add(names[1], T.IntegerType(), False)
    if passages:
        out = out.add(names[2], T.ArrayType(passage), False)
    width = len(keep)

    def run(batches):
        import pyarrow as pa
        m = shared.value
        scores = TokenScores(m.units, m.config.background, m.config.cache_entries)
        for b in batches:
            p, k, found = [], [], []
            for x in b.column(width):
                x = x.as_py()
                n, seg = segments_of(x, scores) if x and m.units else (0, [])
                seg = normalised(n, seg, m) if seg else []
                sig = significant(seg, m)
                p.append(m.probability(sum(v for _, _, v in seg)) if m.units else 0.0)
                k.append(len(sig))
                found.append([{"begin": a, "end": e, "score": v} for a, e, v in sig])
            cols = [*b.columns[:width], pa.array(p, pa.float64()), pa.array(k, pa.int32())]
            if passages:
                kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
                cols = [*cols, pa.array(found, kind)]
            yield pa.RecordBatch.from_arrays(cols, names=out.names)

    scored = src.mapInArrow(run, out)
    if verdict:
        return scored.select(*[F.col(f"`{c}`") for c in keep], (F.col(names[0]) >= 0.5).cast("int").alias(verdict))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
