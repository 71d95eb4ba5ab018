"""N-gram Jaccard join by a token-group matrix.

Similar documents are partitioned into groups; each group's token union is stored; a document's overlap with that union bounds
its overlap with every member, and only groups that the bound lets pass are opened, for the documents that pass it (after Li,
Zhang, Sun and Liu, "LES3", VLDB 2021). The partition itself must not part documents that link: every set is cut into segments by
token hash, in spaces of similar set sizes, with more filled segments than two linked sets can differ in, so linked sets agree on
one segment at least (Deng, Li, Wen and Feng, VLDB 2016). How many they must agree on is known for each set, so each leaves out as
many, less one, of its most frequent segments: what remains of two linked sets still agrees, and passages that many texts share join
nothing. Sets that agree on a segment are joined into families, and groups are cut from families. Most families are one group, which is opened at once. A larger family is cut into groups by size; when those
are opened most of its sets fall into few classes, and it is cut anew by class. Then each set meets the unions of those groups only
that hold a set of another class with which it agrees on a segment, and what passes the bound is compared with the members.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bytehash import LOWER, U, chunks, mix, string_bytes, word_hashes
from .common import BROADCAST_ROWS, Scratch, join_small, map_arrow, quoted, small, table, unwrap, wrap
from .graph import connected_components

CHUNK = 1_000_000
#: Sets in one group, and tokens in one group, at most (one set may be larger).
GROUP, GROUP_TOKENS = 1024, 2_000_000
SEEDS = 4
#: Sets that a task holds against one group's union or members.
QUERIES = 4096
#: Segments of three numbers each, about 60 bytes in memory, that are broadcast at a time, and how many times at most.
SEGMENT_ROWS, SLICES = 400_000, 8


def shingles(buf: np.ndarray, off: np.ndarray, k: int, seed: int, second: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, other tokens, offsets): the distinct k-word shingles of each row as sorted 64-bit hashes, and if asked for as hashes
    of a second kind, in the same places; rows of fewer words are one shingle."""
    n = len(off) - 1
    # A space behind each row keeps words apart.
    joined = np.full(len(buf) + n, 32, np.uint8)
    joined[np.arange(len(buf)) + np.repeat(np.arange(n), np.diff(off))] = LOWER[buf]
    base = off + np.arange(n + 1)
    word = ~((joined == 32) | ((joined >= 9) & (joined <= 13)))
    edge = np.diff(word.astype(np.int8), prepend=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    kinds = word_hashes(joined, start, end, seed, second)
    first = np.searchsorted(start, base)
    count = np.diff(first)

    def chain(h: np.ndarray, m: int) -> np.ndarray:
        x = mix(h[: len(h) - m + 1] ^ U(m))
        for j in range(1, m):
            x = mix(x * U(0xD6E8FEB86659FD93) + h[j : len(h) - m + 1 + j])
        return x

    whole = [chain(h, k) if len(h) >= k else h[:0] for h in kinds]
    out, sizes = [[] for _ in kinds], np.zeros(n + 1, np.int64)
    for i in range(n):
        a, m = first[i], count[i]
        rows = [x[a : a + m - k + 1] for x in whole] if m >= k else [chain(h[a : a + m], m) if m else h[:0] for h in kinds]
        if second:
            t, at = np.unique(rows[0], return_index=True)
            out[1].append(rows[1][at])
        else:
            t = np.unique(rows[0])
        out[0].append(t)
        sizes[i + 1] = len(t)
    flat = [np.concatenate(x) if x else np.zeros(0, U) for x in out]
    return flat[0], flat[-1], np.cumsum(sizes)


@lru_cache(64)
def spaces(num: int, den: int, upto: int) -> list[tuple[int, int, int]]:
    """(least size, segments, filled segments that suffice) of the size classes: a set links only with sets of its own class
    and the next ones, and space k compares class k with itself and class k + 1."""
    out, low = [], 1
    while low <= upto:
        high = max(low, low * den // num)
        differ = (den - num) * (high + high * den // num) // (num + den)
        m = differ + 1
        if differ:  # so many more segments that the expected empty ones, three deviations and a few for common segments can be spared
            spare = (differ + 1 + -(-(differ + 1) * i // 50) for i in range(1, 51))
            empty = lambda x: x * np.exp(-low / x)
            m = next((x for x in spare if empty(x) + 3 * np.sqrt(empty(x)) + (differ + 1) / 32 <= x - differ - 1), 2 * differ + 2)
        out.append((low, m, differ + 1))
        low = high + 1
    return out


def segment_keys(tokens: np.ndarray, off: np.ndarray, num: int, den: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For its own size class's space and the one below, (keys, offsets, spare): for each set one key for each filled segment, and
    on how many filled segments at least it agrees with any set that it links with there."""
    size = np.diff(off)
    table_ = spaces(num, den, 1 << int(max(1, size.max(initial=1))).bit_length())
    lows, segs, need = (np.array(x, np.int64) for x in zip(*table_, strict=True))
    cls = np.searchsorted(lows, size, "right") - 1
    row = np.repeat(np.arange(len(size)), size)
    content = mix(tokens ^ U(0xA24BAED4963EE407))
    out = []
    for down in (0, 1):
        k = cls - down
        ok = (size > 0) & (k >= 0)
        m = np.where(ok, segs[np.maximum(k, 0)], 0)
        base = np.concatenate([[0], np.cumsum(m)])
        use = ok[row]
        r = row[use]
        at = base[r] + (tokens[use] >> U(7)).astype(np.int64) % m[r]
        total, filled = np.zeros(base[-1], U), np.zeros(base[-1], bool)
        np.add.at(total, at, content[use])
        filled[at] = True
        seg_row = np.repeat(np.arange(len(size)), m)
        inner = np.arange(base[-1]) - base[seg_row]
        tag = mix((k[seg_row].astype(U) << U(32)) + inner.astype(U) + U(1))
        key = mix(total + tag)
        # Sets with too few filled segments may agree on empty ones only: one more key for all of them.
        n_filled = np.bincount(seg_row[filled], minlength=len(size))
        spare = np.where(ok, n_filled - need[np.maximum(k, 0)] + 1, 0)
        poor = np.flatnonzero(ok & (spare < 1))
        keys = np.concatenate([key[filled], mix(k[poor].astype(U) + U(0x5851F42D4C957F2D))])
        owner = np.concatenate([seg_row[filled], poor])
        order = np.argsort(owner, kind="stable")
        out.append((keys[order], np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(size)))]), spare))
    return out


def set_id(tokens: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A 64-bit digest of each set."""
    t = np.concatenate([np.zeros(1, U), np.cumsum(mix(tokens ^ U(0x8CB92BA72F3D8DD7)))])
    return mix(t[off[1:]] - t[off[:-1]] + np.diff(off).astype(U) * U(0x9FB21C651E98DF25)).view(np.int64)


def links(a: list[np.ndarray], b: list[np.ndarray] | None, num: int, den: int) -> list[tuple[int, int]]:
    """Pairs (i, j) with |a[i] & b[j]| * den >= |a[i] | b[j]| * num; within a (i < j) if b is None. First the bound: a set whose
    overlap with the other side's token union is too small for any member is closed, until none is left to close."""
    own = b is None
    sides = [a] if own else [a, b]
    sizes = [np.array([len(x) for x in s]) for s in sides]
    live = [np.flatnonzero(n) for n in sizes]
    while True:
        flat = [np.concatenate([s[i] for i in v]) if len(v) else np.zeros(0, U) for s, v in zip(sides, live, strict=True)]
        if own:
            u, n = np.unique(flat[0], return_counts=True)
            common = u[n > 1]
        else:
            common = np.intersect1d(np.unique(flat[0]), np.unique(flat[1]), assume_unique=True)
        kept = []
        for s, v, n in zip(flat, live, sizes, strict=True):
            cum = np.concatenate([[0], np.cumsum(np.isin(s, common))])
            ends = np.concatenate([[0], np.cumsum(n[v])])
            hit = cum[ends[1:]] - cum[ends[:-1]]
            kept.append(v[hit * den >= n[v] * num])
        if all(len(x) == len(y) for x, y in zip(kept, live, strict=True)):
            break
        live = kept
    if any(not len(v) for v in live):
        return []
    both = [s[i] for s, v in zip(sides, live, strict=True) for i in v]
    size = np.array([len(x) for x in both])
    inter = _overlaps(both, common)
    cut = 0 if own else len(live[0])
    inter = inter[: cut or None, cut:]
    union = size[: cut or None, None] + size[None, cut:] - inter
    i, j = np.nonzero((inter * den >= union * num) & (inter > 0))
    last = live[0] if own else live[1]
    return [(x, y) for x, y in zip(live[0][i].tolist(), last[j].tolist(), strict=True) if not own or x < y]


def _overlaps(sets: list[np.ndarray], common: np.ndarray) -> np.ndarray:
    """The matrix of intersection sizes, by the tokens in common (sorted) only."""
    n = len(sets)
    tok, row = np.concatenate(sets), np.repeat(np.arange(n), [len(x) for x in sets])
    at = np.searchsorted(common, tok)
    at[at == len(common)] = 0
    ok = common[at] == tok
    at, row = at[ok], row[ok]
    order = np.argsort(at, kind="stable")
    at, row = at[order], row[order]
    df = np.bincount(at, minlength=len(common))
    out = np.zeros(n * n, np.int64)
    rare = df[at] <= 32
    a, r = at[rare], row[rare]
    for shift in range(1, int(df[a].max(initial=1))):  # pairs of rows that hold a rare token
        same = a[shift:] == a[:-shift]
        out += np.bincount(r[:-shift][same] * n + r[shift:][same], minlength=n * n)
    out = out.reshape(n, n)
    out = out + out.T
    a, r = at[~rare], row[~rare]
    wide, a = np.unique(a, return_inverse=True)
    for c in range(0, len(wide), 4096):  # frequent ones by a product of bit matrices
        use = (a >= c) & (a < c + 4096)
        m = np.zeros((n, min(4096, len(wide) - c)), np.float32)
        m[r[use], a[use] - c] = 1
        out += (m @ m.T).astype(np.int64)
    return out


def _grouped(batches: Iterator[pa.RecordBatch], key: int) -> Iterator[pa.Table]:
    """Tables of consecutive rows with the same first `key` columns, which come sorted."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(key)]
        change = np.zeros(b.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), b.num_rows]
        for i, j in zip(cuts, cuts[1:], strict=False):
            if i == j:
                continue
            now = tuple(c[i] for c in cols)
            if last is not None and now != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(i, j - i))
            last = now
    if held:
        yield pa.Table.from_batches(held)


def _token_sets(col, k: int, seed: int) -> list[np.ndarray]:
    buf, off = string_bytes(col)
    out = []
    for i, j in chunks(off, CHUNK):
        t, _, o = shingles(buf[off[i] : off[j]], off[i : j + 1] - off[i], k, seed)
        out += [t[x:y] for x, y in zip(o, o[1:], strict=False)]
    return out


def _sets(docs: DataFrame, k: int, num: int, den: int, seed: int) -> DataFrame:
    """(id, h, n, s1, s2, keys) of each row (id, text, h); h tells texts of one id apart. s1 and s2 are digests of the set that
    share no hash of any word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, off = string_bytes(b.column(1))
            for i, j in chunks(off, CHUNK):
                t, t2, o = shingles(buf[off[i] : off[j]], off[i : j + 1] - off[i], k, seed, True)
                cols = [b.column(0).slice(i, j - i), b.column(2).slice(i, j - i), pa.array(np.diff(o)), pa.array(set_id(t, o)), pa.array(set_id(t2, o))]
                for keys, ko, spare in segment_keys(t, o, num, den):
                    cols += [pa.ListArray.from_arrays(pa.array(ko.astype(np.int32)), pa.array(keys.view(np.int64))), pa.array(spare)]
                yield pa.RecordBatch.from_arrays(cols, names=["id", "h", "n", "s1", "s2", "keys0", "spare0", "keys1", "spare1"])

    return map_arrow(docs, run, f"id {docs.schema['id'].dataType.simpleString()}, h long, n long, s1 long, s2 long, keys0 array<long>, spare0 long, keys1 array<long>, spare1 long")


ROWS = ["g", "salt", "side", "s1", "text", "tokens"]


def _by_group(rows: DataFrame, one, schema: str) -> DataFrame:
    """rows (g, salt, side, s1, text, tokens), dealt by (g, salt), each with its sides in order; one(table) gives the columns of
    schema, long numbers."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _grouped(batches, 2):
            cols = one(t.rename_columns(ROWS))
            if len(cols[0]):
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) if not isinstance(x, pa.Array) else x for x in cols], names=names)

    dealt = rows.select(*ROWS).repartition("g", "salt").sortWithinPartitions("g", "salt", "side")
    return map_arrow(dealt, run, schema)


def _meant(t: pa.Table, k: int, seed: int, side: int) -> tuple[list[np.ndarray], list[int]]:
    """(sets, digests) of one side's rows. Ids that are repeated with other texts bring rows that are not meant; equal sets come once."""
    rows = t.filter(pc.equal(t.column("side"), side))
    sets = _token_sets(rows.column("text"), k, seed) if rows.num_rows else []
    flat = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int64)
    got = set_id(np.concatenate(sets), flat) if sets else np.zeros(0, np.int64)
    good = np.flatnonzero(got == rows.column("s1").to_numpy())
    _, one = np.unique(got[good], return_index=True)
    good = good[one]
    return [sets[i] for i in good], [int(x) for x in got[good]]


def _open(rows: DataFrame, k: int, num: int, den: int, seed: int, pairs: bool) -> DataFrame:
    """Links (a, b) between sets of side 0, or with pairs between sets of side 1 and of side 0: of each group a spanning forest,
    which says as much about classes as all of them."""

    def one(t: pa.Table) -> list[list[int]]:
        (a, x), (b, y) = _meant(t, k, seed, 0), _meant(t, k, seed, 1) if pairs else (None, [])
        found = links(a, b, num, den) if len(a) and (not pairs or len(b)) else []
        other = y if pairs else x
        root: dict[int, int] = {}

        def find(v: int) -> int:
            while root.setdefault(v, v) != v:
                root[v] = v = root[root[v]]
            return v

        out: list[list[int]] = [[], []]
        for i, j in found:
            p, q = find(x[i]), find(other[j])
            if p != q:
                root[max(p, q)] = min(p, q)
                out[0].append(x[i])
                out[1].append(other[j])
        return out

    return _by_group(rows, one, "a long, b long")


def _unions(rows: DataFrame, k: int, seed: int) -> DataFrame:
    """The matrix: (g, tokens), each group's token union."""

    def one(t: pa.Table) -> list:
        sets, _ = _meant(t, k, seed, 0)
        u = np.unique(np.concatenate(sets)) if sets else np.zeros(0, U)
        return [pa.array([t.column("g")[0].as_py()]), pa.ListArray.from_arrays(pa.array([0, len(u)], pa.int32()), pa.array(u.view(np.int64)))]

    return _by_group(rows, one, "g long, tokens array<long>")


def _bound(rows: DataFrame, k: int, num: int, den: int, seed: int) -> DataFrame:
    """(s1, g) of the sets of side 1 whose overlap with the union of side 0 lets them link with a member."""

    def one(t: pa.Table) -> list:
        union = t.column("tokens")[0].values  # of side 0, which comes first
        u = np.zeros(0, U) if union is None else union.to_numpy().view(U)
        sets, ids = _meant(t, k, seed, 1)
        keep = [i for s, i in zip(sets, ids, strict=True) if np.isin(s, u, assume_unique=True).sum() * den >= len(s) * num]
        return [keep, [t.column("g")[0].as_py()] * len(keep)]

    return _by_group(rows, one, "s1 long, g long")


def _with_text(d: DataFrame, rows: DataFrame, broadcast_rows: int, scratch: Scratch) -> DataFrame:
    """rows (id, g, salt, side, s1) with the text of their id. The ids are broadcast if they are few; else texts are dealt by id."""
    rows = scratch.table(rows.select(F.col("id").alias("i"), "g", "salt", "side", "s1"), "members")
    side = F.broadcast(rows) if small(rows, broadcast_rows) else rows
    return d.select("id", "text").join(side, F.col("id").eqNullSafe(F.col("i"))).withColumn("tokens", F.lit(None).cast("array<long>")).select(*ROWS)


def _digests(d: DataFrame, words: int, num: int, den: int, scratch: Scratch) -> tuple[DataFrame, DataFrame, int]:
    """(sets, classes of equal sets, seed). Different sets of one digest differ in the other one: then another seed is taken."""
    for seed in range(1, SEEDS + 1):
        sets = scratch.table(_sets(d, words, num, den, seed), "sets")
        classes = sets.where("n > 0").groupBy("s1").agg(F.min("id").alias("id"), F.min("s2").alias("lo"), F.max("s2").alias("hi"), F.count(F.lit(1)).alias("c"), F.min("n").alias("n"))
        classes = scratch.table(classes, "classes")
        if not classes.where("lo <> hi").limit(1).count():
            return sets, classes, seed
    raise RuntimeError("digests of different sets stay equal")


def _followed(sets: DataFrame, broadcast_rows: int, scratch: Scratch) -> DataFrame:
    """(s1, k, a) of the segments by which sets are looked for; a is the least set of segment k. Linked sets have one of these in
    common."""
    def keys(of: int = 1, i: int = 0) -> DataFrame:
        """All sets' segments, or slice i of them."""
        out = None
        for d in (0, 1):
            k = F.filter(f"keys{d}", lambda x: F.pmod(x, F.lit(of)) == i) if of > 1 else F.col(f"keys{d}")
            part = sets.where("n > 0").select("s1", F.lit(d).alias("down"), F.col(f"spare{d}").alias("spare"), F.explode(k).alias("k"))
            out = part if out is None else out.unionByName(part)
        return out

    shared = keys().groupBy("k").agg(F.min("s1").alias("lo"), F.max("s1").alias("hi"), F.count(F.lit(1)).alias("c")).where("lo <> hi")
    shared = scratch.table(shared.select("k", F.col("lo").alias("a"), "c"), "segments")
    # A slice of them is broadcast at a time. Beyond SLICES both sides are dealt by segment; adaptive execution splits the segments
    # of many copies.
    room = min(SEGMENT_ROWS, 4 * broadcast_rows)
    slices = -(-shared.count() // room) if room else SLICES + 1
    held = ["s1", "down", "spare", "k", "a", "c"]
    if slices <= SLICES:
        star = None
        for i in range(max(1, slices)):
            part = shared.where(F.pmod("k", F.lit(max(1, slices))) == i)
            part = scratch.table(keys(max(1, slices), i).join(F.broadcast(part), "k").select(*held).distinct(), "segments")
            star = part if star is None else star.unionByName(part)
    else:
        star = scratch.table(keys().join(shared, "k").select(*held).distinct(), "segments")
    # Passages that many texts share fill whole segments. A set agrees on `spare` segments at least with whatever it links with, so
    # it can leave out its spare - 1 most frequent ones: in one order of all segments, the rarest that two linked sets agree on has
    # spare - 1 of them behind it in either set, and is left out by neither.
    rank = F.row_number().over(Window.partitionBy("s1", "down").orderBy(F.desc("c"), F.desc("k")))
    return scratch.table(star.withColumn("rank", rank).where("rank >= spare").select("s1", "k", "a"), "followed")


def _families(followed: DataFrame, classes: DataFrame, num: int, den: int, group: int, broadcast_rows: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Sets (s1, id, n, fam, large, cls, g) and, of large families, the groups (fam, cls, g, parts, lead): pieces of similar size."""
    fam = connected_components(followed.where("s1 <> a").select("a", F.col("s1").alias("b")).distinct(), broadcast_rows, into=scratch).select(F.col("v").alias("s1"), F.col("label").alias("fam"))
    fam = fam.join(classes.select("s1", "id", "n"), "s1")
    total = fam.groupBy("fam").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("tokens"))
    fam = scratch.table(join_small(fam, scratch.table(total, "families"), ["fam"], "inner", F.col("s1"), rows=broadcast_rows), "families")
    large = (F.col("m") > group) | (F.col("tokens") > GROUP_TOKENS)
    low = [x for x, _, _ in spaces(num, den, 1 << 40)]
    cls = F.when(large, F.array_size(F.filter(F.array(*[F.lit(x).cast("long") for x in low]), lambda x: x <= F.col("n")))).otherwise(0)
    fam = fam.withColumn("cls", cls.cast("int"))
    pieces = fam.groupBy("fam", "cls").agg(F.greatest(F.ceil(F.count(F.lit(1)) / group), F.ceil(F.sum("n") / GROUP_TOKENS)).cast("long").alias("parts"), F.min("s1").alias("lead"))
    pieces = scratch.table(pieces, "groups")
    fam = join_small(fam, pieces, ["fam", "cls"], "inner", F.col("s1"), rows=broadcast_rows)
    return scratch.table(fam.select("s1", "id", "n", "fam", large.alias("large"), "cls", _gid(F.pmod(F.xxhash64("s1"), F.col("parts")))), "groups"), pieces


def _gid(piece) -> Column:
    return F.xxhash64("fam", "cls", piece.cast("long")).alias("g")


def _first_round(fam: DataFrame, pieces: DataFrame, classes: DataFrame) -> DataFrame:
    """Each group by itself, with the leader of its size class and of the next one, so that a family of near copies in many groups
    becomes one class at once."""
    lead = pieces.where("cls > 0").select("fam", "lead", F.explode(F.array("cls", F.col("cls") - 1)).alias("cls")).join(pieces.select("fam", "cls", "parts"), ["fam", "cls"])
    lead = lead.where("cls > 0").select(F.col("lead").alias("s1"), "fam", "cls", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("p")).select("s1", _gid(F.col("p")))
    lead = lead.join(classes.select("s1", "id"), "s1")
    return fam.select("id", "s1", "g").unionByName(lead.select("id", "s1", "g")).distinct().withColumns({"salt": F.lit(0), "side": F.lit(0)})


def _second_groups(big: DataFrame, first: DataFrame, group: int, broadcast_rows: int, scratch: Scratch) -> DataFrame:
    """The sets of large families, (s1, id, label, g, lo, hi), in groups by the class (label) that they have reached: large classes
    in groups of their own, small ones together. lo and hi are the least and largest label in the group."""
    lab = connected_components(first, broadcast_rows, into=scratch)
    big = join_small(big.select("s1", "id", "n", "fam", "cls"), lab.withColumnRenamed("v", "s1"), ["s1"], "left", F.col("s1"), rows=broadcast_rows)
    big = scratch.table(big.withColumn("label", F.coalesce("label", "s1")), "large")
    size = big.groupBy("fam", "cls", "label").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("tokens"))
    alone = (F.col("m") > group / 2) | (F.col("tokens") > GROUP_TOKENS / 2)
    parts = lambda m, tokens, room: F.greatest(F.ceil(m / (group * room)), F.ceil(tokens / (GROUP_TOKENS * room)), F.lit(1)).cast("long")
    rest = size.where(~alone).groupBy("fam", "cls").agg(parts(F.sum("m"), F.sum("tokens"), 0.5).alias("rest"))
    size = size.select("fam", "cls", "label", alone.alias("alone"), parts(F.col("m"), F.col("tokens"), 1).alias("parts"))
    big = join_small(big, scratch.table(size, "large"), ["fam", "cls", "label"], "inner", F.col("s1"), rows=broadcast_rows)
    big = join_small(big, scratch.table(rest, "large"), ["fam", "cls"], "left", F.col("s1"), rows=broadcast_rows)
    g = F.when(F.col("alone"), F.xxhash64("fam", "cls", "label", F.pmod(F.xxhash64("s1"), F.col("parts")))).otherwise(F.xxhash64("fam", "cls", F.pmod(F.xxhash64("label"), F.col("rest"))))
    big = scratch.table(big.select("s1", "id", "cls", "label", g.alias("g")), "large")
    ends = scratch.table(big.groupBy("g").agg(F.min("label").alias("lo"), F.max("label").alias("hi")), "large")
    return scratch.table(join_small(big, ends, ["g"], "inner", F.col("s1"), rows=broadcast_rows), "large")


def _candidates(big: DataFrame, followed: DataFrame, broadcast_rows: int, scratch: Scratch) -> DataFrame:
    """(s1, g): sets of large families and the groups of another class, or of several, that hold a set with which they agree on a
    segment; of a pair of groups one side only."""
    f = scratch.table(join_small(followed.select("s1", "k"), big.withColumnsRenamed({"g": "own", "cls": "c"}), ["s1"], "inner", F.col("k"), rows=broadcast_rows), "agreed")
    held = f.select("k", F.col("own").alias("g"), "c", "lo", "hi").distinct()
    # By classes first: segments within one class are settled, however many sets agree on them.
    who = f.select(F.col("k").alias("k2"), F.col("label").alias("l2"), F.col("own").alias("own2"), F.col("c").alias("c2")).distinct()
    open_ = ~((F.col("lo") == F.col("hi")) & (F.col("lo") == F.col("l2")))
    once = (F.col("c2") > F.col("c")) | ((F.col("c2") == F.col("c")) & (F.col("own2") >= F.col("g")))
    pairs = scratch.table(who.join(held, F.col("k2") == F.col("k")).where(open_ & once).select("k2", "l2", "own2", "g").distinct(), "agreed")
    same = (F.col("k") == F.col("k2")) & (F.col("label") == F.col("l2")) & (F.col("own") == F.col("own2"))
    side = F.broadcast(pairs) if small(pairs, broadcast_rows) else pairs
    return scratch.table(f.join(side, same).select("s1", "id", "g").distinct(), "candidates")


def _salted(pairs: DataFrame, other: DataFrame, broadcast_rows: int, scratch: Scratch) -> DataFrame:
    """Rows (id, g, salt, side, s1): pairs (s1, id, g) as side 1, QUERIES of a group in a task or so, and the rows of other (s1, id,
    g) whose group is in pairs as side 0, once for each task."""
    n = scratch.table(pairs.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("tasks")), "tasks")
    q = join_small(pairs, n, ["g"], "inner", F.col("s1"), rows=broadcast_rows).select("id", "g", F.pmod(F.xxhash64("s1"), F.col("tasks")).cast("int").alias("salt"), F.lit(1).alias("side"), "s1")
    o = join_small(other, n, ["g"], "inner", F.col("s1"), rows=broadcast_rows).select("id", "g", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("salt"), F.lit(0).alias("side"), "s1")
    return q.unionByName(o)


def jaccard_classes(
    docs: DataFrame, words: int = 5, threshold: float | Fraction = Fraction(4, 5), id_col: str = "doc_id", text_col: str = "text", group: int = GROUP, broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """One row for each row of docs: id_col, h, n_shingles, component_id.

    Two texts link when the Jaccard similarity of their sets of `words`-word shingles (A-Z folded to a-z) is threshold or more;
    component_id is the least id that links reach, itself included. A text of fewer words is one shingle, its whole sequence; a
    text without words, or null, has no shingle and links with nothing, so its component_id is its own id. Texts are read whole,
    however long. h is a hash of the text. A null id counts as none: it is never a component's id unless all of its members are
    null. Repeated rows get one row each. An empty table gives no rows. Other columns are ignored, whatever their names. Exact but
    for hashes of shingles, 64 bits within one pair of texts; different sets of one digest are found out by a second digest, made
    from other hashes of the words, and the run starts again under another seed (SEEDS times, then it fails).
    """
    t = Fraction(threshold).limit_denominator(1000)
    num, den = t.numerator, t.denominator
    scratch = Scratch(docs.sparkSession)
    d = docs.select(F.col(quoted(id_col)).alias("id"), F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit("")).alias("text"))
    d = d.withColumn("h", F.xxhash64("text"))
    sets, classes, seed = _digests(d, words, num, den, scratch)
    followed = _followed(sets, broadcast_rows, scratch)
    fam, pieces = _families(followed, classes, num, den, group, broadcast_rows, scratch)
    first = scratch.table(_open(_with_text(d, _first_round(fam, pieces, classes), broadcast_rows, scratch), words, num, den, seed, False), "found")
    found = first
    large = fam.where("large")
    if large.limit(1).count():
        big = _second_groups(large, first, group, broadcast_rows, scratch)
        todo = _candidates(big, followed, broadcast_rows, scratch)
        if todo.limit(1).count():
            member = big.select("s1", "id", "g")
            asked = scratch.table(todo.select("g").distinct(), "asked")
            needed = join_small(member, asked, ["g"], "inner", F.col("s1"), rows=broadcast_rows).withColumns({"salt": F.lit(0), "side": F.lit(0)})
            matrix = scratch.table(_unions(_with_text(d, needed, broadcast_rows, scratch), words, seed), "matrix")
            queries = _salted(todo, matrix.select(F.lit(0).cast("long").alias("s1"), F.lit(None).cast(d.schema["id"].dataType).alias("id"), "g"), broadcast_rows, scratch)
            unions = queries.where("side = 0").select("g", "salt").join(matrix, "g").select("g", "salt", F.lit(0).alias("side"), F.lit(0).cast("long").alias("s1"), F.lit(None).cast("string").alias("text"), "tokens")
            passed = scratch.table(_bound(_with_text(d, queries.where("side = 1"), broadcast_rows, scratch).unionByName(unions), words, num, den, seed).distinct(), "passed")
            passed = join_small(passed, classes.select("s1", "id"), ["s1"], "inner", F.col("g"), rows=broadcast_rows)
            opened = _salted(scratch.table(passed.select("s1", "id", "g"), "passed"), member, broadcast_rows, scratch)
            second = scratch.table(_open(_with_text(d, opened, broadcast_rows, scratch), words, num, den, seed, True), "found")
            found = first.unionByName(second)

    lab = connected_components(found, broadcast_rows, into=scratch).withColumnRenamed("v", "s1")
    known = classes.join(lab, "s1", "left").withColumn("root", F.coalesce("label", "s1"))
    least = known.where("label is not null").groupBy("root").agg(F.min("id").alias("least"))
    tell = known.where("label is not null or c > 1").select("s1", "root", F.col("id").alias("own")).join(least, "root", "left").select("s1", F.coalesce("least", "own").alias("component_id"))
    tell = scratch.table(tell, "classes")
    sets_out = scratch.table(sets.select("id", "h", "n", "s1"), "sets")
    scratch.drop(sets_out, tell)
    out = join_small(sets_out, tell, ["s1"], "left", F.hash("id", "h"), rows=broadcast_rows)
    return out.select(F.col("id").alias(id_col), "h", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component_id", "id")).otherwise(F.col("id")).alias("component_id"))


def drop_near_copies(docs: DataFrame, words: int = 5, threshold: float | Fraction = Fraction(4, 5), id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """docs with one document of each class, that of the least id, all columns as they came, whatever their names. Documents without
    words (null, empty), and those whose component_id is null, stay; rows that repeat the least id stay all; very long texts and an
    empty table as in jaccard_classes."""
    scratch = Scratch(docs.sparkSession)
    c = jaccard_classes(docs, words, threshold, id_col, text_col, broadcast_rows=broadcast_rows)
    gone = c.where(F.col("component_id").isNotNull() & ~F.col("component_id").eqNullSafe(F.col(quoted(id_col)))).select(F.col(quoted(id_col)).alias("gone_id"), F.col("h").alias("gone_h")).distinct()
    gone = scratch.table(gone, "near")
    d = wrap(docs, id=F.col(quoted(id_col)), h=F.xxhash64(F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit(""))))
    side = F.broadcast(gone) if small(gone, broadcast_rows) else gone
    return unwrap(d.join(side, F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("h") == F.col("gone_h")), "left_anti"))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its class, at three words and 0.9. Null and empty texts link with nothing; see jaccard_classes."""
    return jaccard_classes(table(spark, sf_dir, "documents"), 3, Fraction(9, 10)).drop("h")
