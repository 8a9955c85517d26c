"""Problem 7: near-duplicates by an exact join of k-mer sets.

Two sets that share `threshold` of their union share at least one of their rarest k-mers: with a global order of the
k-mers, a set of n needs no more than its first n - ceil(threshold n) + 1 (its prefix). The order is by how often k-mers
occur in all texts, counted in a table of fixed size; any one order keeps the join exact, a good one keeps it short.
Places in the prefix, sizes and the parity of the k-mers in SIGNS classes leave out pairs that cannot reach the threshold,
and no others. The k-mer sets decide; a banded alignment of anchors (k-mers picked by hash, in text order) gives the
common course. Copies are reduced to one representative first, so a hot group of copies costs one row; k-mers that many
different texts share are joined in blocks of a fixed size.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import durable, table

K = 5
#: Copies of one text are listed in all pairs up to so many, unless all are asked for; beyond, each is paired with the least
#: id of its group.
ALL_PAIRS = 50
#: K-mers are counted by so many bits of their hash.
BITS = 20
#: Classes of k-mers whose parity is compared, and texts that one task joins.
SIGNS, TEXTS = 1024, 16_000
#: A k-mer that may stand in more texts is joined in blocks of about so many.
HOT = 1 << 15
#: Pairs of places that are looked at together.
STEP = 1 << 21
#: Texts that share one key are joined in blocks of about so many.
BLOCK = 1000
MOST_SENT = 500_000
#: An anchor is a k-mer whose hash is divisible by this; the band is this share of the anchors, on each side.
ANCHOR, BAND = 6, 0.35


def squeezed(text: Column) -> Column:
    """Lower case, without white space."""
    return F.lower(F.regexp_replace(text, r"(?U)\s+", ""))


def kmer_hashes(text: str, k: int = K) -> np.ndarray:
    """64-bit hashes of all k-mers in text order."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(c) - k + 1
    if n < 1:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            h = (h ^ c[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return h


def batch_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """kmer_hashes of texts of at least K characters at once, and where the k-mers of each begin and end."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    h = kmer_hashes("".join(texts))
    ok = np.ones(len(h), bool)
    for k in range(1, K):  # k-mers across two texts
        ok[np.cumsum(size)[:-1] - k] = False
    ends = np.cumsum(size - K + 1)
    return h[ok], ends - (size - K + 1), ends


def course(a: list[int], b: list[int], band: float = BAND) -> float:
    """Length of the longest common subsequence of two anchor sequences within a band about the diagonal, over the
    shorter length; bit-parallel. A text whose halves changed places keeps the longer half."""
    if not a or not b:
        return 1.0
    if len(a) > len(b):
        a, b = b, a
    n, m = len(a), len(b)
    width = max(4, int(band * m)) + (m - n)
    where: dict[int, int] = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    full = (1 << m) - 1
    v = full
    for i, x in enumerate(a):
        hits = where.get(x, 0)
        if hits:
            lo = max(0, i - width)
            hits = hits >> lo << lo & (1 << min(m, i + width + 1)) - 1
            u = v & hits
            v = ((v + u) | (v - u)) & full
    return (m - v.bit_count()) / n


def profile(text: str) -> tuple[np.ndarray, list[int]]:
    """The distinct k-mers (64-bit hashes, sorted) and the anchors of a text."""
    h = kmer_hashes(text)
    return np.unique(h), h[h % np.uint64(ANCHOR) == 0].tolist()


def compare(a: tuple[np.ndarray, list[int]], b: tuple[np.ndarray, list[int]], threshold: float = 0.0) -> tuple[float, float]:
    """Course of the anchors (best of the texts as they are and of their second halves moved to the front) and the
    Jaccard similarity of the k-mer sets, whatever the course; the course is 0 where the similarity is under the
    threshold."""
    ka, kb = a[0], b[0]
    both = len(ka) + len(kb) - len(np.unique(np.concatenate([ka, kb])))
    similarity = both / max(1, len(ka) + len(kb) - both)
    if similarity < threshold:
        return 0.0, similarity
    aa, ab = a[1], b[1]
    c = course(aa, ab)
    if c < 0.6:
        c = max(c, course(aa[len(aa) // 2 :] + aa[: len(aa) // 2], ab))
    return c, similarity


def candidates(keyed: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, b), a < b, of all ids that share a key; keyed: (_id, _key). A key of more than `block` ids is cut into blocks,
    and every two blocks meet in a row group of their own, so no task holds more than two."""
    n = F.count("*").over(Window.partitionBy("_key"))
    multi = durable(keyed.withColumn("_n", n).where("_n > 1"))
    # most keys are one block that meets itself
    blocks = F.ceil(F.col("_n") / block).cast("int")
    own = F.pmod(F.xxhash64("_id"), blocks).cast("int")
    cells = multi.select("_id", "_key", own.alias("_own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("_other"))
    cells = cells.select("_id", "_key", "_own", F.least("_own", "_other").alias("_i"), F.greatest("_own", "_other").alias("_j"))
    keys = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in ("_key", "_i", "_j")]
    apart = (F.col("l._i") == F.col("l._j")) | (F.col("l._own") != F.col("r._own"))
    met = cells.alias("l").join(cells.alias("r"), [*keys, F.col("l._id") < F.col("r._id"), apart])
    return met.select(F.col("l._id").alias("a"), F.col("r._id").alias("b")).distinct()


def counted(rows: DataFrame, key: str) -> tuple[DataFrame, np.ndarray]:
    """The distinct (key, _copy) of rows (key, _copy, _u), and for every value of the first BITS bits of a k-mer hash eight
    times the binary logarithm of its count over all rows: 0 for what occurs once at most."""
    kind, size = rows.schema[key].dataType.simpleString(), 1 << 16

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << BITS, np.int64)
        names, types = [key, "_copy", "_chunk", "_counts"], None
        for b in batches:
            types = b.column(0).type
            if b.num_rows:
                counts += np.bincount((batch_hashes(b.column(2).to_pylist())[0] >> np.uint64(64 - BITS)).astype(np.int64), minlength=1 << BITS)
            none = pa.nulls(b.num_rows, pa.int32()), pa.nulls(b.num_rows, pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *none], names=names)
        if types is not None:
            chunks = [zlib.compress(counts[k : k + size].tobytes(), 1) for k in range(0, len(counts), size)]
            none = pa.nulls(len(chunks), types), pa.nulls(len(chunks), pa.binary())
            yield pa.RecordBatch.from_arrays([*none, pa.array(range(len(chunks)), pa.int32()), pa.array(chunks, pa.binary())], names=names)

    def total(f: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"_chunk": f["_chunk"].iloc[:1], "_counts": [sum(np.frombuffer(zlib.decompress(c), np.int64) for c in f["_counts"]).tobytes()]})

    both = durable(rows.select(key, "_copy", "_u").mapInArrow(run, f"`{key}` {kind}, _copy binary, _chunk int, _counts binary"))
    counts = np.zeros(1 << BITS, np.int64)
    for r in both.where("_chunk IS NOT NULL").select("_chunk", "_counts").groupBy("_chunk").applyInPandas(total, "_chunk int, _counts binary").collect():
        counts[r[0] * size : (r[0] + 1) * size] = np.frombuffer(r[1], np.int64)
    level = np.minimum(255, 8 * np.log2(np.maximum(counts, 1))).astype(np.uint8)
    return both.where("_chunk IS NULL").select(key, "_copy").distinct(), level


def tokens_of(text: str, level: np.ndarray) -> np.ndarray:
    """The distinct k-mers of a text as numbers, the rarest first: the level in the first byte, the hash in the others."""
    return np.unique(ordered(kmer_hashes(text), level))


def ordered(h: np.ndarray, level: np.ndarray) -> np.ndarray:
    """Hashes of k-mers with the level in the first byte."""
    return level[h >> np.uint64(64 - BITS)].astype(np.uint64) << np.uint64(56) | h & np.uint64((1 << 56) - 1)


def prefix(t: np.ndarray, threshold: float, own: int) -> tuple[np.ndarray, np.ndarray]:
    """32-bit keys of the k-mers that a text of these tokens must share one of with any other, and their places. K-mers of
    one text only are left out; those of very many texts have a key for every pair of blocks that the text takes part in."""
    n = len(t)
    t = t[: min(n, n - int(np.ceil(threshold * n - 1e-9)) + 1)]
    levels = t >> np.uint64(56)
    place = np.flatnonzero(levels > 0)
    mixed = t[place] * np.uint64(0x9E3779B97F4A7C15)
    if len(t) and levels[-1] >= 8 * np.log2(HOT):
        blocks = np.maximum(1, np.ceil(2.0 ** ((levels[place] + 1.0) / 8) / HOT)).astype(np.int64)
        at = np.repeat(np.arange(len(place)), blocks)
        other = np.arange(len(at)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        mine = own % blocks[at]
        cell = (np.minimum(mine, other) * blocks[at] + np.maximum(mine, other)).astype(np.uint64)
        place, mixed = place[at], (mixed[at] + cell) * np.uint64(0xD6E8FEB86659FD93)
    return (mixed >> np.uint64(32)).astype(np.uint32), place.astype(np.int32)


def signs(t: np.ndarray) -> bytes:
    """The parity of the number of tokens in each of SIGNS classes: two sets differ by at least as many tokens as bits."""
    return np.packbits(np.bincount((t & np.uint64(SIGNS - 1)).astype(np.int64), minlength=SIGNS) & 1 > 0).tobytes()


def met(ids: np.ndarray, n: np.ndarray, sign: np.ndarray, of: np.ndarray, keys: np.ndarray, place: np.ndarray, threshold: float) -> Iterator[np.ndarray]:
    """Pairs of ids that share a key and may reach the threshold. Of text k: ids[k], n[k] tokens, sign[k]; of entry i: its
    text of[i], its key and its place in the prefix."""
    share = threshold / (1 + threshold)
    least = lambda both: np.ceil(share * both - 1e-9)  # tokens that two texts of so many together have to share
    at = keys.astype(np.uint64) << np.uint64(32) | n[of].astype(np.uint64)
    o = np.argsort(at, kind="stable")
    at, of, place = at[o], of[o], place[o]
    size = n[of].astype(np.int64)
    # the text that is not longer than the other has the shared k-mer early
    early = np.flatnonzero(size - place >= least(2 * size))
    longest = np.minimum(size[early] / threshold + 1e-9 if threshold > 0 else np.inf, 0xFFFFFFFF).astype(np.uint64)
    more = np.searchsorted(at, at[early] >> np.uint64(32) << np.uint64(32) | longest, "right") - early - 1
    a = 0
    ends = np.cumsum(more)
    while a < len(early):
        z = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + STEP, "right")))
        m = more[a:z]
        i = np.repeat(early[a:z], m)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(m) - m, m)
        a = z
        need = least(size[i] + size[j])
        ok = (size[i] - place[i] >= need) & (size[j] - place[j] >= need) & (of[i] != of[j])
        x, y = of[i[ok]].astype(np.int64), of[j[ok]].astype(np.int64)
        both = np.unique(np.minimum(x, y) * len(ids) + np.maximum(x, y))
        x, y = both // len(ids), both % len(ids)
        differ = np.zeros(len(x), np.int64)
        for some in np.array_split(np.arange(sign.shape[1]), 2):
            for k in some:
                differ += np.bitwise_count(sign[x, k] ^ sign[y, k])
            total = n[x].astype(np.int64) + n[y]
            ok = differ <= total - 2 * least(total)
            x, y, differ = x[ok], y[ok], differ[ok]
        p, q = ids[x], ids[y]
        yield np.stack([np.minimum(p, q), np.maximum(p, q)])


def joined(rows: DataFrame, level: np.ndarray, threshold: float, parts: int) -> DataFrame:
    """(a, b), a < b, of the hashes of all copies that may reach the threshold, each pair once. rows: (_copy, _u)."""
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast(level)  # 2^BITS bytes
    # one number for every partition
    names = {r.p: r.i for r in spark.range(64 * parts).select(F.col("id").cast("int").alias("i")).select("i", F.pmod(F.hash("i"), F.lit(parts)).alias("p")).collect()}
    name = np.array([names.get(k, k) for k in range(parts)], np.int32)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # copies; bounded
        for b in batches:
            if len(seen) > 100_000:
                seen.clear()
            out: list[list] = [[], [], [], [], [], []]
            new = {i: t for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if i not in seen}
            seen.update(new)
            h, first, last = batch_hashes(list(new.values())) if new else (np.zeros(0, np.uint64),) * 3
            h = ordered(h, sent.value)
            for i, x, y in zip(new, first.tolist(), last.tolist(), strict=True):
                t = np.unique(h[x:y])
                keys, place = prefix(t, threshold, i)
                part = keys % np.uint32(parts)
                o = np.argsort(part, kind="stable")
                keys, place, part = keys[o], place[o], part[o]
                begins = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else part
                ends, sign = np.append(begins[1:], len(part)), signs(t)
                for x, y in zip(begins.tolist(), ends.tolist(), strict=False):
                    for column, v in zip(out, (int(name[part[x]]), i, len(t), sign, keys[x:y].tobytes(), place[x:y].tobytes()), strict=True):
                        column.append(v)
            types = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, types, strict=True)], names=["_part", "_id", "_n", "_sign", "_keys", "_places"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [c for b in batches if b.num_rows for c in [pa.Table.from_batches([b])]]
        if not got:
            return
        t = pa.concat_tables(got)
        ids, first = np.unique(t["_id"].to_numpy(), return_index=True)
        # a copy that came twice in one part gave equal rows
        whole = pd.DataFrame({"part": t["_part"].to_numpy(), "id": t["_id"].to_numpy()})
        rows_ = np.flatnonzero(~whole.duplicated().to_numpy())
        n = t["_n"].to_numpy()[first]
        sign = np.frombuffer(b"".join(t["_sign"].take(pa.array(first)).to_pylist()), np.uint64).reshape(len(first), SIGNS // 64)
        few = t.take(pa.array(rows_))
        raw = few["_keys"].to_pylist()
        keys, place = np.frombuffer(b"".join(raw), np.uint32), np.frombuffer(b"".join(few["_places"].to_pylist()), np.int32)
        of = np.repeat(np.searchsorted(ids, few["_id"].to_numpy()), [len(k) // 4 for k in raw])
        for p, q in met(ids, n, sign, of, keys, place, threshold):
            yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(q)], names=["a", "b"])

    sketched = rows.select(F.xxhash64("_copy").alias("_id"), "_u").mapInArrow(sketch, "_part int, _id long, _n int, _sign binary, _keys binary, _places binary")
    return sketched.repartition(parts, "_part").mapInArrow(meet, "a long, b long").distinct()


def links(df: DataFrame, key: str = "page_id", text: str = "text", threshold: float = 0.75, least_chars: int = 400) -> tuple[DataFrame, DataFrame]:
    """(links, members). links: (a, b, course, similarity, copy_a, copy_b) of all representatives with a <= b and similarity
    of the sets of K-character sequences at or above the threshold; a = b only where a key has several texts. members:
    (representative, key, copy), one row per key and text with at least least_chars squeezed characters; copy identifies
    the squeezed text, a representative is the least key of equal texts. Repeated rows count once; null keys are left out;
    empty input gives two empty frames."""
    u = squeezed(F.col(text))
    rows = df.where(F.col(key).isNotNull()).select(key, u.alias("_u")).where(F.length("_u") >= max(K, least_chars)).select(key, F.unhex(F.md5("_u")).alias("_copy"), "_u")
    heads, level = counted(rows, key)
    heads = durable(heads)
    reps = heads.groupBy("_copy").agg(F.min(key).alias("_rep"))
    members = heads.join(reps, "_copy").select(F.col("_rep").alias("representative"), key, F.col("_copy").alias("copy"))
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-heads.count() // TEXTS))
    pairs = durable(joined(rows, level, threshold, parts))
    named = reps.withColumn("_id", F.xxhash64("_copy"))
    # up to MOST_SENT texts are sent for by every executor, so that texts of other rows aren't moved; beyond, rows are joined
    wanted = durable(named.join(pairs.select(F.explode(F.array("a", "b")).alias("_id")).distinct(), "_id", "left_semi"))
    keys = wanted.select(F.col("_rep").alias(key)).distinct()
    if wanted.count() <= MOST_SENT:
        keys, wanted = F.broadcast(keys), F.broadcast(wanted)
    texts = df.select(key, text).join(keys, key, "left_semi").select(F.col(key).alias("_rep"), u.alias("_u")).where(F.length("_u") >= max(K, least_chars)).withColumn("_copy", F.unhex(F.md5("_u")))
    texts = texts.join(wanted, ["_rep", "_copy"]).dropDuplicates(["_copy"]).select("_id", "_rep", "_copy", "_u")
    full = pairs.join(texts.toDF("a", "ka", "ca", "ua"), "a").join(texts.toDF("b", "kb", "cb", "ub"), "b")
    one, two = (F.struct(F.col("k" + c).alias("k"), F.col("c" + c).alias("c"), F.col("u" + c).alias("u")) for c in "ab")
    full = full.select(F.least(one, two).alias("x"), F.greatest(one, two).alias("y")).select(F.col("x.k").alias("a"), F.col("y.k").alias("b"), F.col("x.c").alias("copy_a"), F.col("y.c").alias("copy_b"), F.col("x.u").alias("_ua"), F.col("y.u").alias("_ub"))
    kind = df.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            got = []
            for k in range(0, len(f), 200):  # the profiles of a few hundred texts at a time
                a, b = f["_ua"].iloc[k : k + 200], f["_ub"].iloc[k : k + 200]
                known = {t: profile(t) for t in {*a, *b}}
                got += [compare(known[x], known[y], threshold) for x, y in zip(a, b, strict=True)]
            out = f[["a", "b"]].assign(course=[g[0] for g in got], similarity=[g[1] for g in got], copy_a=f["copy_a"], copy_b=f["copy_b"])
            yield out[out.similarity >= threshold]

    return durable(full.mapInPandas(run, f"a {kind}, b {kind}, course double, similarity double, copy_a binary, copy_b binary")), members


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of an undirected graph with columns a, b; component is the least node. Alternating large and
    small stars: every round joins on nodes only, and hubs are aggregated before they are joined."""
    e = durable(edges.where("a <> b").select("a", "b").distinct())
    while True:
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("x"), F.col("m").alias("y")), F.struct(F.col("a").alias("x"), F.col("m").alias("y")))).alias("p")).select(F.col("p.x").alias("a"), F.col("p.y").alias("b")).where("a <> b").distinct()
        new = durable(small)
        if new.exceptAll(e).isEmpty() and e.exceptAll(new).isEmpty():
            break
        e = new
    stars = e.groupBy("a").agg(F.min("b").alias("component"))
    return stars.select(F.col("a").alias("node"), "component").union(stars.select(F.col("component").alias("node"), "component").distinct())


def pairs_of(found: DataFrame, members: DataFrame, key: str, most: int | None = ALL_PAIRS) -> DataFrame:
    """All pairs (a < b) of keys that the links and the copies mean; most: see ALL_PAIRS, for large groups of copies, None
    for all pairs."""
    m = members.select("copy", F.col("representative").alias("rep"), F.col(key).alias("k"))
    counted_ = m.join(m.groupBy("copy").agg(F.count("*").alias("n")), "copy")
    listed = F.lit(True) if most is None else F.col("n") <= most
    small = durable(counted_.where(listed | (F.col("rep") == F.col("k"))).select("copy", "k"))
    within = durable(counted_.where("n > 1"))
    copies = candidates(within.where(listed).select(F.col("k").alias("_id"), F.col("copy").alias("_key")))
    stars = within.where(~listed & (F.col("rep") != F.col("k"))).select(F.col("rep").alias("a"), F.col("k").alias("b"))
    across = found.select("copy_a", "copy_b").join(small.toDF("copy_a", "ka"), "copy_a").join(small.toDF("copy_b", "kb"), "copy_b").select(F.least("ka", "kb").alias("a"), F.greatest("ka", "kb").alias("b"))
    return copies.union(stars).union(across.where("a < b")).distinct()


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of near-duplicate pages, all pairs of copies among them."""
    found, members = links(table(spark, sf_dir, "doc_pages"))
    return pairs_of(found, members, "page_id", None).toDF("page_id_a", "page_id_b")


def p7_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with a near-duplicate: its representative among equal texts, its group and the links of that text."""
    found, members = links(table(spark, sf_dir, "doc_pages"))
    found = found.where("a < b")
    groups = components(found)
    ends = found.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    reps = members.groupBy("representative").agg(F.count("*").alias("n_copies"))
    out = members.join(reps, "representative").join(groups.withColumnRenamed("node", "representative"), "representative", "left").join(ends.withColumnRenamed("node", "representative"), "representative", "left")
    return out.where("n_copies > 1 OR component IS NOT NULL").select("page_id", "representative", F.coalesce("component", "representative").alias("group_id"), "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"))


QUERIES = {"p7_found": p7_found, "p7_groups": p7_groups}
SQL: dict[str, str] = {}
