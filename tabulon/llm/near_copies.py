"""Near-copies of documents by MinHash banding, exact checks and components.

1. Every text becomes its set of word shingles (64-bit hashes; the whole
   sequence when it has fewer words) and ``bands * rows`` universal hash minima
   ``min((a x + b) >> 32)``.  Texts with equal sets are one *class*, stood for
   by its smallest id; only classes go on.
2. A band is a group of ``rows`` minima; classes that agree on a whole band
   meet in a bucket.  A pair of Jaccard similarity 0.8 is missed by all bands
   with probability ``(1 - 0.8^rows)^bands`` (1e-5 with the defaults).
3. *Stars first*: in every bucket each class is paired with the smallest one
   only; the pairs are confirmed on full sets and give first components.  A
   bucket of near-copies is one component then, without its n^2 pairs.
4. *What is left*: members of buckets that still hold several components are
   compared in blocks, on signatures (agreeing minima).  Pairs whose estimate is
   within ``slack`` of the threshold join components into *groups*; a block
   writes at most one edge per member.  All members of a group are then compared
   on full sets, in pairs of blocks, and again a block writes at most one true
   link per member.  No bucket or group is cut or dropped, and no n^2 pairs are
   written.
5. Connected components of all confirmed links (alternating large-star and
   small-star) give the result.

Full sets are not stored: texts that take part in a candidate pair are read
again and shingled again for the confirmation.

Defined results: null text or text without words has an empty set, 0 shingles
and links with nothing; a null id is its own (null) component and is kept;
repeated ids give a row each and share a component; ties go to the smaller id;
an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm.common import partitions, settled, small_batches
from tabulon.llm.components import connected_components


@dataclass(frozen=True)
class MinHashConfig:
    words: int = 5             # words in a shingle
    percent: int = 80          # link: 100 * |A n B| >= percent * |A u B|
    bands: int = 30
    rows: int = 5
    slack: float = 0.15        # about 4.5 standard deviations of the estimate at 0.8
    block: int = 512           # classes of one bucket compared in one task
    seed: int = 20240229


_MIX = 0x9E3779B97F4A7C15


def word_sequence(text: str) -> list[bytes]:
    """Words as runs of anything but space, tab, LF, VT, FF and CR; A-Z lower-cased
    (``bytes.lower`` and ``bytes.split`` mean exactly these characters)."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def shingle_set(text: str | None, words: int):
    """Sorted distinct 64-bit shingle hashes."""
    import numpy as np
    from xxhash import xxh3_64_intdigest
    seq = word_sequence(text) if text else []
    if not seq:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, seq), np.uint64, len(seq))
    n = max(1, len(seq) - words + 1)
    with np.errstate(over="ignore"):
        out = np.zeros(n, np.uint64)
        for i in range(min(words, len(seq))):
            out = (out ^ h[i:i + n]) * np.uint64(_MIX)
            out ^= out >> np.uint64(29)
    # the number of words tells a short sequence from a shingle
    return np.unique(out ^ np.uint64(min(words, len(seq))))


class Minima:
    """Universal hash minima of a shingle set."""

    def __init__(self, cfg: MinHashConfig):
        import numpy as np
        rng = np.random.Generator(np.random.PCG64(cfg.seed))
        n = cfg.bands * cfg.rows
        self.a = rng.integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 2**64, n, dtype=np.uint64)

    def of(self, shingles):
        import numpy as np
        best = None
        with np.errstate(over="ignore"):
            x = (shingles >> np.uint64(32)) ^ (shingles & np.uint64(0xFFFFFFFF))   # 32-bit keys
            for s in range(0, len(x), 256):                                        # stays in cache
                part = x[s:s + 256]
                m = (self.a[:, None] * part[None, :] + self.b[:, None]).min(axis=1)
                best = m if best is None else np.minimum(best, m)
        return best >> np.uint64(32)


def _signatures(cfg: MinHashConfig):
    def run(batches: Iterable) -> Iterator:
        import hashlib

        import numpy as np
        import pyarrow as pa
        minima = Minima(cfg)                     # 16 bits of each are kept: enough to propose pairs
        for b in batches:
            size, key, sig = [], [], []
            for x in b.column(1):
                s = shingle_set(x.as_py(), cfg.words)
                size.append(len(s))
                key.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                sig.append((minima.of(s) & np.uint64(0xFFFF)).astype("<u2").tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array(size, pa.int64()), pa.array(key, pa.binary()), pa.array(sig, pa.binary())],
                names=["id", "text_hash", "n_shingles", "set_key", "sig"])
    return run


def _band_keys(cfg: MinHashConfig):
    """(id, band, key) rows: the 64-bit hash of each band of a signature."""
    def run(batches: Iterable) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from xxhash import xxh3_64_intdigest
        width = 2 * cfg.rows
        for b in batches:
            ids = b.column(0)
            keys = np.array([[xxh3_64_intdigest(s[i * width:(i + 1) * width], seed=i) for i in range(cfg.bands)]
                             for s in b.column(1).to_pylist()], dtype=np.uint64).reshape(len(ids), cfg.bands)
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(np.repeat(np.arange(len(ids)), cfg.bands))),
                 pa.array(keys.astype(np.int64).ravel())], names=["id", "bucket"])
    return run


def _roots(n: int):
    """Union-find over 0 .. n-1: (find, join); the smaller index is the root."""
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def join(i: int, j: int) -> bool:
        i, j = find(i), find(j)
        root[max(i, j)] = min(i, j)
        return i != j
    return find, join


def _seeded(comp):
    """Union-find in which members of one component are together already."""
    import numpy as np
    find, join = _roots(len(comp))
    _, first, inv = np.unique(comp, return_index=True, return_inverse=True)
    for i, j in enumerate(first[inv].tolist()):
        join(i, j)
    return find, join


def _edges(ids, us, vs):
    import numpy as np
    import pyarrow as pa
    u, v = ids[np.array(us, np.int64)], ids[np.array(vs, np.int64)]
    return pa.table({"u": np.minimum(u, v), "v": np.maximum(u, v)})


def _likely(cfg: MinHashConfig):
    """A forest over the components of one pair of blocks of a bucket: at most
    one edge per member, from pairs whose signatures agree enough."""
    least = cfg.percent / 100.0 - cfg.slack

    def run(t):
        import numpy as np
        n = t.num_rows
        ids, blk = t.column("id").to_numpy(), t.column("blk").to_numpy()
        find, join = _seeded(t.column("comp").to_numpy())
        sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), "<u2").reshape(n, -1)
        left, right = (np.flatnonzero(blk == t.column(c)[0].as_py()) for c in ("lo", "hi"))
        us, vs = [], []
        for i in left.tolist():
            near = right[(sig[right] == sig[i]).mean(axis=1) >= least]
            for j in near.tolist():
                if join(i, j):
                    us.append(i)
                    vs.append(j)
        return _edges(ids, us, vs)
    return run


def _links_of_block(cfg: MinHashConfig):
    """True links between the components of one pair of blocks, a forest again.
    An index from shingles to members counts all common shingles of a member
    at once."""
    def run(t):
        import numpy as np
        ids, blk, comp = (t.column(c).to_numpy() for c in ("id", "blk", "comp"))
        if len(np.unique(comp)) < 2:
            return _edges(ids, [], [])
        find, join = _seeded(comp)
        sets = [shingle_set(x.as_py(), cfg.words) for x in t.column("text")]
        size = np.array([len(x) for x in sets])
        _, name = np.unique(np.concatenate(sets), return_inverse=True)
        owner = np.repeat(np.arange(len(sets)), size)
        by_name = np.argsort(name, kind="stable")
        holders, begin = owner[by_name], np.r_[0, np.cumsum(np.bincount(name))]
        own = np.r_[0, np.cumsum(size)]
        lo, hi = t.column("lo")[0].as_py(), t.column("hi")[0].as_py()
        us, vs = [], []
        for i in np.flatnonzero(blk == lo).tolist():
            mine = name[own[i]:own[i + 1]]
            both = np.bincount(np.concatenate([holders[begin[x]:begin[x + 1]] for x in mine.tolist()]), minlength=len(sets))
            link = (100 * both >= cfg.percent * (size[i] + size - both)) & (blk == hi)
            for j in np.flatnonzero(link).tolist():
                if join(i, j):
                    us.append(i)
                    vs.append(j)
        return _edges(ids, us, vs)
    return run


def _in_blocks(members: DataFrame, key: str, size: int) -> DataFrame:
    """Members of a group dealt into blocks, once for every pair of blocks."""
    n = members.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / F.lit(size)).cast("long").alias("nb"))
    d = members.join(n, key).withColumn("blk", F.pmod(F.xxhash64("id"), F.col("nb")))
    d = d.withColumn("_o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)))
    return d.withColumn("lo", F.least("blk", "_o")).withColumn("hi", F.greatest("blk", "_o")).drop("_o", "nb")


def _confirm(cfg: MinHashConfig):
    """True links of rows sorted by centre, each centre's own text first: one
    centre's set is held at a time."""
    def run(batches: Iterable) -> Iterator:
        import numpy as np
        import pyarrow as pa
        u, centre = None, None
        for b in batches:
            us, vs = [], []
            for key, i, own, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3)):
                s = shingle_set(text.as_py(), cfg.words)
                if own:
                    u, centre = key, s
                    continue
                assert key == u, "a partner arrived before its centre"
                both = len(np.intersect1d(centre, s, assume_unique=True))
                if 100 * both >= cfg.percent * (len(centre) + len(s) - both):
                    us.append(u)
                    vs.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])
    return run


def confirm_links(pairs: DataFrame, texts: DataFrame, cfg: MinHashConfig) -> DataFrame:
    """The pairs (u, v) whose full sets are similar enough.

    A centre u with many partners is dealt over groups of about 64 partners,
    each with its own copy of the centre's text."""
    size = pairs.groupBy("u").agg(F.ceil(F.count(F.lit(1)) / F.lit(64)).alias("n"))
    p = pairs.join(size, "u").select("u", "v", F.pmod(F.xxhash64("v"), F.col("n")).alias("g"))
    sides = (p.select("u", "g", F.col("v").alias("id"), F.lit(False).alias("own"))
             .unionByName(p.select("u", "g", F.col("u").alias("id"), F.lit(True).alias("own")).distinct()))
    rows = sides.join(texts, "id").select("u", "id", "own", "text", "g")
    dealt = rows.repartition("u", "g").sortWithinPartitions("u", "g", F.desc("own"))
    return dealt.drop("g").mapInArrow(_confirm(cfg), "u long, v long")


def _classes_and_links(docs: DataFrame, cfg: MinHashConfig, id_col: str, text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (id, text_hash, n_shingles, set_key), classes of equal sets (set_key,
    number c, and the smallest id and its text_hash) and links of class numbers."""
    spark = docs.sparkSession
    small_batches(spark)
    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    src = src.withColumn("text_hash", F.xxhash64("text"))
    all_rows = settled(src.mapInArrow(_signatures(cfg), "id long, text_hash long, n_shingles long, set_key binary, sig binary"))

    # classes of equal sets; each is stood for by its smallest id, and named by a
    # number, as an id with several texts may stand for several classes
    have = all_rows.where("set_key is not null and id is not null")
    classes = settled(have.groupBy("set_key").agg(F.min(F.struct("id", "text_hash", "sig")).alias("_m")).select(
        "set_key", F.monotonically_increasing_id().alias("c"), F.col("_m.id").alias("rep"),
        F.col("_m.text_hash").alias("rep_hash"), F.col("_m.sig").alias("sig")))
    reps = classes.select(F.col("c").alias("id"), "sig")

    bands = reps.mapInArrow(_band_keys(cfg), "id long, bucket long")
    low = bands.groupBy("bucket").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low <> high")
    buckets = settled(bands.join(low.select("bucket", "low"), "bucket"))

    # the text whose set stands for the class, also when its id has others
    wanted = buckets.select("id").distinct().join(classes.select(F.col("c").alias("id"), "rep", "rep_hash"), "id")
    wanted = wanted.select(F.col("id").alias("c"), F.col("rep").alias("id"), F.col("rep_hash").alias("text_hash"))
    texts = src.where("id is not null").join(wanted, ["id", "text_hash"]).groupBy("id", "text_hash").agg(
        F.min("c").alias("c"), F.max("text").alias("text"))
    texts = settled(texts.select(F.col("c").alias("id"), "text"))

    stars = buckets.where("id <> low").select(F.col("low").alias("u"), F.col("id").alias("v")).distinct()
    links = settled(confirm_links(stars, texts, cfg))
    comp = connected_components(links)

    named = buckets.join(comp, F.col("id") == F.col("node"), "left").select(
        "bucket", "id", F.coalesce("component", "id").alias("comp"))
    mixed = named.groupBy("bucket").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a <> b").select("bucket")
    # signatures are small: larger blocks, so that each is sent to fewer pairs of blocks
    left = _in_blocks(named.join(mixed, "bucket"), "bucket", 4 * cfg.block).join(reps, "id")
    likely = settled(left.groupBy("bucket", "lo", "hi").applyInArrow(_likely(cfg), "u long, v long").distinct())
    # whole groups that may link: each member's text is read once per pair of blocks
    group = connected_components(links.unionByName(likely))
    open_ = group.join(likely.select(F.col("u").alias("node")).distinct(), "node", "left_semi").select("component").distinct()
    inside = (group.join(open_, "component").select(F.col("node").alias("id"), F.col("component").alias("group"))
              .join(comp, F.col("id") == F.col("node"), "left").select("group", "id", F.coalesce("component", "id").alias("comp")))
    tiles = _in_blocks(inside, "group", cfg.block // 2).join(texts, "id")
    links2 = tiles.groupBy("group", "lo", "hi").applyInArrow(_links_of_block(cfg), "u long, v long")

    return all_rows.drop("sig"), classes.drop("sig"), links.unionByName(links2)


def near_copies(docs: DataFrame, cfg: MinHashConfig = MinHashConfig(), id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_shingles, component_id and kept for every row of ``docs``."""
    all_rows, classes, links = _classes_and_links(docs, cfg, id_col, text)
    have = all_rows.where("set_key is not null and id is not null").select("id", "set_key")
    same = have.join(classes.select("set_key", "rep"), "set_key").where("id <> rep").select(F.col("rep").alias("u"), F.col("id").alias("v"))
    name = classes.select("c", "rep")
    by_id = (links.join(name.select(F.col("c").alias("u"), F.col("rep").alias("_u")), "u")
             .join(name.select(F.col("c").alias("v"), F.col("rep").alias("_v")), "v")
             .where("_u <> _v").select(F.least("_u", "_v").alias("u"), F.greatest("_u", "_v").alias("v")))
    final = connected_components(by_id.unionByName(same))
    out = all_rows.select("id", "n_shingles").join(final, F.col("id") == F.col("node"), "left")
    return out.select(F.col("id").alias(id_col), "n_shingles", F.coalesce("component", "id").alias("component_id"),
                      F.coalesce(F.coalesce("component", "id") == F.col("id"), F.lit(True)).alias("kept"))


def near_copy_texts(docs: DataFrame, cfg: MinHashConfig = MinHashConfig(), id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, text_hash (``xxhash64``), n (rows) and kept for every text of an id:
    components are of texts, so the other texts of an id are judged alone.  Rows
    without an id or without words are left out."""
    all_rows, classes, links = _classes_and_links(docs, cfg, id_col, text)
    comp = connected_components(links)
    named = classes.join(comp, F.col("c") == F.col("node"), "left")
    first = named.groupBy(F.coalesce("component", "c").alias("g")).agg(F.min(F.struct("rep", "rep_hash")).alias("_m")).select(
        F.col("_m.rep").alias("id"), F.col("_m.rep_hash").alias("text_hash"), F.lit(True).alias("kept"))
    rows = all_rows.where("set_key is not null and id is not null").groupBy("id", "text_hash").agg(F.count(F.lit(1)).alias("n"))
    return rows.join(first, ["id", "text_hash"], "left").select(
        F.col("id").alias(id_col), "text_hash", "n", F.coalesce("kept", F.lit(False)).alias("kept"))
