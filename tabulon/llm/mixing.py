"""Mixing documents to target domain weights by soft membership (built-in
functions only).

1. *Classifier*: a naive Bayes model over whether a text holds a token, from a
   labelled table (id, domain).  Tokens are ranked by the G statistic; the best
   ``max_tokens`` are kept, so the broadcast model has a stated size.  The
   labelled rows are a sample bounded by ``max_labelled`` (smallest hashes).
2. *Posteriors*: every text's distinct tokens are joined with the model and
   summed per document.  The exploded rows of a document lie in one task, so
   the partial sums leave about one row per document to shuffle.
3. *Rates*: with ``n_d`` tokens and posteriors ``p_d`` the expected tokens of
   domain k are ``a_k = sum_d r_d n_d p_dk``.  Accelerated projected gradient descent
   from rate 1 minimises the squared distance from the targets ``t_k`` (weighted by
   ``1/m_k``, ``m_k`` the domain's tokens at rate 1) over nonnegative rates, documents
   weighted by their tokens, with a small pull ``ridge`` towards rate 1.  A
   document's gradient is ``sum_k p_dk (a_k - t_k) / m_k``, whose curvature is at most
   1, so a step of length 1 is one expression over the table and needs K + 2 sums of
   one aggregate: the totals, the squared projected gradient, and whether the
   momentum still points downhill (else it begins anew).  It ends when the projected
   gradient is below ``tolerance``.  A rate has no upper bound unless ``max_rate``
   sets one.  Targets out of reach, and what a cap or ``max_steps`` leaves, are told
   in a warning and by ``target_report``.
4. *Copies*: ``floor(rate + u)`` with ``u`` a uniform hash of the id, so the
   expected copies equal the rate.

Defined results: null or empty texts have no tokens and get the prior
posteriors (rate as fitted); without labelled rows all domains share alike;
labelled rows with a null id or domain, or a domain without a target, do not
teach; conflicting labels of one id all teach; tokens of equal gain are taken in
their own order; repeated ids are one document with their tokens together; a very
long text is one row of distinct tokens; an empty table gives an empty table.  Only
the id and the text are read, so other columns may have any name.
"""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass
from typing import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.llm.common import as_row, settled


@dataclass(frozen=True)
class MixConfig:
    max_labelled: int = 20_000
    max_tokens: int = 4_000
    min_documents: int = 5
    smoothing: float = 20.0        # pseudo-documents behind every token share
    max_rate: float | None = None  # upper bound of a rate; none by default, so that rare domains reach their targets
    tolerance: float = 1e-5        # of the projected gradient, as a root mean square over tokens
    max_steps: int = 400
    ridge: float = 1e-6            # weight of the distance from rate 1 against that from the targets
    seed: int = 7


#: a miss of a domain's tokens that is told, as a share of all tokens
_TOLD = 1e-3


def _words(text: Column) -> Column:
    return F.split(F.lower(text), r"\s+")


def _word_count(words: Column) -> Column:
    """Words without the empty ends that splitting leaves."""
    return (F.size(words) - (F.element_at(words, 1) == "").cast("int")
            - ((F.element_at(words, -1) == "") & (F.size(words) > 1)).cast("int"))


def domain_model(docs: DataFrame, labelled: DataFrame, domains: list[str], cfg: MixConfig, id_col: str, text: str):
    """(model table: token, w_0 .. w_K-1; log priors).  At most max_tokens + 1 rows."""
    k = len(domains)
    index = F.create_map(*[F.lit(x) for i, d in enumerate(domains) for x in (d, i)])
    lab = (labelled.select(F.col(f"`{id_col}`").alias("_id"), index[F.col("domain")].alias("_k")).dropna().distinct()
           .orderBy(F.xxhash64("_id"), "_id", "_k").limit(cfg.max_labelled))
    d = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text}`").cast("string").alias("_t")).where("_t is not null")
    seen = d.join(F.broadcast(lab), "_id").select("_k", F.array_distinct(F.array_append(_words(F.col("_t")), F.lit(""))).alias("_w"))
    counts = seen.select("_k", F.explode("_w").alias("token")).groupBy("token").agg(
        *[F.count_if(F.col("_k") == i).alias(f"c_{i}") for i in range(k)])
    counts = settled(counts.where(sum((F.col(f"c_{i}") for i in range(k)), F.lit(0)) >= cfg.min_documents).unionByName(
        docs.sparkSession.range(1).select(F.lit("").alias("token"), *[F.lit(0).cast("long").alias(f"c_{i}") for i in range(k)])))
    n = [float(x or 0) for x in counts.where("token = ''").agg(*[F.max(f"c_{i}") for i in range(k)]).first()]
    total = sum(n)
    prior = [math.log((x + 1) / (total + k)) for x in n]
    share = sum((F.col(f"c_{i}") for i in range(k)), F.lit(0)) / F.lit(max(total, 1.0))
    weight = [F.log((F.col(f"c_{i}") + cfg.smoothing * share) / F.lit(n[i] + cfg.smoothing)) - F.log(share) for i in range(k)]
    gain = sum((F.col(f"c_{i}") * weight[i] for i in range(k)), F.lit(0.0))
    best = (counts.where("token <> ''").select("token", *[w.alias(f"w_{i}") for i, w in enumerate(weight)], gain.alias("_g"))
            .orderBy(F.desc("_g"), "token").limit(cfg.max_tokens).drop("_g"))
    # the empty token, which every text is given, keeps texts without a known token
    none = docs.sparkSession.range(1).select(F.lit("").alias("token"), *[F.lit(0.0).alias(f"w_{i}") for i in range(k)])
    return settled(best.unionByName(none)), prior


def posteriors(docs: DataFrame, model: DataFrame, prior: list[float], id_col: str, text: str) -> DataFrame:
    """_id, n_tokens and p_0 .. p_K-1 (they sum to 1), one row per id."""
    k = len(prior)
    d = docs.select(F.col(f"`{id_col}`").alias("_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("_t"))
    d = d.select("_id", _words(F.col("_t")).alias("_w"))
    d = d.select("_id", _word_count(F.col("_w")).cast("long").alias("_n"), F.explode(F.array_union(F.array(F.lit("")), "_w")).alias("token"))
    hits = d.join(F.broadcast(model), "token")
    per = hits.groupBy("_id").agg(F.sum(F.when(F.col("token") == "", F.col("_n"))).alias("n_tokens"),
                                  *[F.sum(f"w_{i}").alias(f"s_{i}") for i in range(k)])
    score = [F.col(f"s_{i}") + F.lit(prior[i]) for i in range(k)]
    top = F.greatest(*score) if k > 1 else score[0]
    per = per.select("_id", "n_tokens", *[F.exp(s - top).alias(f"e_{i}") for i, s in enumerate(score)])
    norm = sum((F.col(f"e_{i}") for i in range(1, k)), F.col("e_0"))
    return per.select("_id", "n_tokens", *[(F.col(f"e_{i}") / norm).alias(f"p_{i}") for i in range(k)])


#: steps whose expressions are nested before the rates are settled
_NESTED = 4


def fit_rates(soft: DataFrame, targets: list[float], cfg: MixConfig, total_tokens: float | None = None) -> DataFrame:
    """Adds ``rate`` to a settled table of n_tokens and posteriors."""
    k = len(targets)
    p, n = [F.col(f"p_{i}") for i in range(k)], F.col("n_tokens")
    dot = lambda v: sum((F.lit(float(x)) * c for x, c in zip(v, p)), F.lit(0.0))

    def project(x: Column) -> Column:
        x = F.greatest(F.lit(0.0), x)
        return x if cfg.max_rate is None else F.least(F.lit(float(cfg.max_rate)), x)

    def sums(d: DataFrame, *more: Column) -> list[float]:
        return [float(x or 0.0) for x in d.agg(*[F.sum(F.col("rate") * n * c) for c in p], *[F.sum(m) for m in more]).first()]

    rates = soft.withColumn("rate", F.lit(1.0))
    now = sums(rates)
    mass, total = [max(x, 1.0) for x in now], float(total_tokens) if total_tokens is not None else sum(now)
    if total <= 0:
        return rates
    t = [total * x / sum(targets) for x in targets]
    rates = rates.withColumn("_old", F.col("rate"))
    before, age, push, nested = now, 1.0, 0.0, 0
    for _ in range(cfg.max_steps):
        # the point ahead, by the momentum of the last step, and its totals, which are linear in it
        ahead = F.col("rate") + F.lit(push) * (F.col("rate") - F.col("_old"))
        slope = [(x + push * (x - y) - w) / m for x, y, w, m in zip(now, before, t, mass)]
        d = rates.withColumn("_ahead", ahead)
        d = d.withColumn("_new", project(F.col("_ahead") - dot(slope) - F.lit(cfg.ridge) * (F.col("_ahead") - 1)))
        d = d.withColumn("_move", F.col("_new") - F.col("_ahead"))                   # the projected gradient
        d = d.withColumns({"_old": F.col("rate"), "rate": F.col("_new")}).drop("_ahead", "_new")
        *new, left, turn = sums(d, n * F.col("_move") ** 2, n * F.col("_move") * (F.col("rate") - F.col("_old")))
        rates, before, now, nested = d.drop("_move"), now, new, nested + 1
        if left <= cfg.tolerance ** 2 * total:
            break
        age = 1.0 if turn < 0 else age                                               # the momentum points uphill: begin anew
        following = (1 + math.sqrt(1 + 4 * age * age)) / 2
        push, age = (age - 1) / following, following
        if nested == _NESTED:
            rates, nested = settled(rates), 0
    rates = settled(rates.drop("_old"))        # later filters would copy the nested steps
    if any(abs(a - b) > _TOLD * total for a, b in zip(now, t)):
        warnings.warn(f"mixing: wanted tokens by domain {t}, reached {now}", stacklevel=2)
    return rates


def mix_documents(docs: DataFrame, labelled: DataFrame, targets: Mapping[str, float], cfg: MixConfig = MixConfig(),
                  id_col: str = "doc_id", text: str = "text", total_tokens: float | None = None) -> DataFrame:
    """One row per id: id, n_tokens, ``p_<domain>``, rate and copies.

    ``targets`` gives the wanted share of tokens of each domain; ``labelled`` has
    the id and ``domain``; ``total_tokens`` defaults to the corpus as it is."""
    domains = sorted(targets)
    if any(targets[d] < 0 for d in domains) or not sum(targets.values()) > 0:
        raise ValueError("target weights must be nonnegative and not all zero")
    model, prior = domain_model(docs, labelled, domains, cfg, id_col, text)
    soft = settled(posteriors(docs, model, prior, id_col, text))
    out = fit_rates(soft, [float(targets[d]) for d in domains], cfg, total_tokens)
    # 31 bits of the hash as a number in [0, 1)
    u = F.pmod(F.xxhash64(F.lit(cfg.seed), F.col("_id")), F.lit(2**31)) / F.lit(float(2**31))
    return out.select(F.col("_id").alias(id_col), "n_tokens", *[F.col(f"p_{i}").alias(f"p_{d}") for i, d in enumerate(domains)],
                      "rate", F.floor(F.col("rate") + u).cast("int").alias("copies"))


def target_report(mixed: DataFrame, targets: Mapping[str, float], total_tokens: float | None = None) -> DataFrame:
    """One row per domain: the tokens wanted, those the rates reach, their
    difference (missed) and those of the drawn copies."""
    domains = sorted(targets)
    by = lambda times: F.create_map(*[x for d in domains for x in (
        F.lit(d), F.coalesce(F.sum(F.col(times) * F.col("n_tokens") * F.col(f"p_{d}")), F.lit(0.0)))])
    total = F.lit(float(total_tokens)) if total_tokens is not None else F.coalesce(F.sum("n_tokens"), F.lit(0)).cast("double")
    one = mixed.agg(total.alias("total"), by("rate").alias("reached"), by("copies").alias("copied"))
    share = F.create_map(*[F.lit(x) for d in domains for x in (d, targets[d] / sum(targets.values()))])
    rows = one.select(F.explode(share).alias("domain", "share"), "total", "reached", "copied")
    wanted, reached = F.col("total") * F.col("share"), F.col("reached")[F.col("domain")]
    return rows.select("domain", wanted.alias("wanted"), reached.alias("reached"), (wanted - reached).alias("missed"),
                       F.col("copied")[F.col("domain")].alias("copied"))


def apply_mix(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs``, each as often as ``copies`` says.  Only ids that are
    not kept exactly once meet the texts."""
    odd = mixed.where("copies <> 1").select(F.col(f"`{id_col}`").alias("id"), "copies", F.lit(True).alias("odd"))
    rows = docs.select(as_row(docs).alias("row")).join(odd, F.col(f"row.`{id_col}`").eqNullSafe(F.col("id")), "left")
    times = F.when(F.col("odd"), F.col("copies")).otherwise(F.lit(1))
    return rows.select("row", F.explode(F.array_repeat(F.lit(0), times))).select("row.*")
