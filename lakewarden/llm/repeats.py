"""Removal of repeated passages by a depth-limited radix sort of suffixes.

A suffix matters only through its first LENGTH bytes, its window. The first digit of the sort is an anchor: of the GRAM-byte
strings in a window the one of least hash, which depends on nothing but the window's bytes, so equal windows meet under the
same anchor at the same offset, and only about one position in 77 has to be dealt out (Schleimer, Wilkerson and Aiken,
"Winnowing", SIGMOD 2003). Anchors of one occurrence hold no repeated window and are dropped. The rest are dealt by anchor, with
the bytes around them, and each anchor's windows are refined by most-significant-digit passes of 50 bytes each; windows that are
alone after a pass are dropped, and groups that are left after the last, compared byte by byte, are the repeated windows.

The windows of an anchor of more than GROUP occurrences are dealt by one more digit: the distances of windows from the anchor are
cut into slices, and all windows of a slice share some bytes, which become part of the key. The more occurrences, the finer the
slices and the longer that digit, up to whole windows. Occurrences of such an anchor with equal bytes all around are combined
where they are read: one of them stands for them, so no task meets more of them than there are tasks that read.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytehash import Hashed, U, chunks, mix, string_bytes
from .common import SALTS, Scratch, map_arrow, quoted, table

LENGTH, GRAM = 200, 48
#: Occurrences beyond which an anchor's windows are dealt by another digit too, and the slices that makes at least.
GROUP, SLICES = 16_384, 3
#: Surroundings of such anchors that a task remembers.
REMEMBERED = 50_000
#: Bytes of text, and members of whole anchors, that are worked on at once; small enough for a core's cache.
CHUNK, BATCH, WINDOWS = 250_000, 1024, 160_000


def _sliding(x: np.ndarray, w: int, op) -> np.ndarray:
    """op over each w consecutive values: len(x) - w + 1 results, by doubling."""
    have = 1
    while have * 2 <= w:
        x = op(x[:-have], x[have:])
        have *= 2
    return op(x[: len(x) - (w - have)], x[w - have :]) if w > have else x


def anchors(buf: np.ndarray, off: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(positions, gram hashes, rows) of the anchors of all windows of length bytes inside the rows. Of equal least ranks in one
    window all are anchors."""
    n, w = len(buf), length - gram + 1
    none = np.zeros(0, np.int64)
    size = np.diff(off)
    if n < length or not (size >= length).any():
        return none, none.view(U), none
    hashed = Hashed(buf)
    raw = hashed.sums[gram:] - hashed.sums[:-gram]
    raw *= hashed.down[: len(raw)]
    top = np.uint32(2**32 - 1)
    rank = ((raw * U(0xD6E8FEB86659FD93)) >> U(32)).astype(np.uint32)
    np.clip(rank, 1, top - np.uint32(1), out=rank)  # 0: no window
    for e in off[1:].tolist():  # grams that leave their row
        rank[max(0, e - gram + 1) : e] = top
    low = _sliding(rank, w, np.minimum)  # by window
    for e, m in zip(off[1:].tolist(), size.tolist(), strict=True):  # windows that leave their row
        low[max(e - m, e - length + 1, 0) : e] = 0
    least = np.zeros(len(rank) + w - 1, np.uint32)
    least[w - 1 : w - 1 + len(low)] = low
    best = _sliding(least, w, np.maximum)  # over the windows that hold the position
    at = np.flatnonzero((best == rank) & (rank != top))
    row = np.searchsorted(off, at, "right") - 1
    return at - off[row], mix(raw[at].copy()), row


def repeated_windows(ctx: np.ndarray, left: np.ndarray, size: np.ndarray, group: np.ndarray, length: int, digit: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """(member, start) of the repeated windows. ctx: the members' bytes one after the other, size each; left: bytes in front of
    the anchor; group: the members' anchor. Windows are compared at the same distance from the anchor only."""
    off = np.concatenate([[0], np.cumsum(size)])
    count = np.maximum(size - length + 1, 0)
    hashed = Hashed(ctx)
    members, starts = [], []
    eight = np.ndarray((len(ctx) + 1,), "<u8", np.concatenate([ctx, np.zeros(8, np.uint8)]), 0, (1,))
    # A share of the distances at a time, so that the windows at hand are bounded.
    step = max(1, int(WINDOWS * (length + 1) // max(1, count.sum())))
    for near in range(0, length + 1, step):
        first, end = np.maximum(left - near - step + 1, 0), np.minimum(left - near + 1, count)
        n = np.maximum(end - first, 0)
        member = np.repeat(np.arange(len(size)), n)
        if not len(member):
            continue
        start = np.arange(len(member)) - np.repeat(np.cumsum(n) - n - first, n)
        sort = mix(group[member].astype(np.int64).view(U) * U(0x9E3779B97F4A7C15) + (left[member] - start + length).astype(U))
        for at in range(0, length, digit):
            a = off[member] + start + at
            sort = mix(sort * U(0xD6E8FEB86659FD93) ^ hashed.of(a, a + min(digit, length - at)))
            order = np.argsort(sort)
            s = sort[order]
            same = s[1:] == s[:-1]
            twice = np.zeros(len(s), bool)
            twice[1:] |= same
            twice[:-1] |= same
            keep = np.sort(order[twice])
            member, start, sort = member[keep], start[keep], sort[keep]
            if not len(member):
                break
        if len(member):
            same = _equal(ctx, eight, off[member] + start, sort, length)
            members.append(member[same])
            starts.append(start[same])
    member, start = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (members, starts))
    return member, start


def _equal(ctx: np.ndarray, eight: np.ndarray, at: np.ndarray, sort: np.ndarray, length: int) -> np.ndarray:
    """Which of the windows at `at` have the same bytes as another one of equal `sort`. Each of two or more equal digests is compared
    with its neighbour, eight bytes at a time; where those differ, a digest's windows are told apart by their bytes."""
    order = np.argsort(sort, kind="stable")
    s, a = sort[order], at[order]
    pair = np.flatnonzero(s[1:] == s[:-1])
    differ = np.zeros(len(pair), bool)
    for o in [*range(0, length - 7, 8), length - 8]:
        differ |= eight[a[pair] + o] != eight[a[pair + 1] + o]
    keep = np.ones(len(at), bool)
    for d in set(s[pair[differ]].tolist()):
        held: dict[bytes, list[int]] = {}
        for i in np.flatnonzero(sort == U(d)).tolist():
            held.setdefault(ctx[at[i] : at[i] + length].tobytes(), []).append(i)
        for x in held.values():
            keep[x] = len(x) > 1
    return keep


def _runs(member: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(member, from, to): consecutive windows of a member as one run of bytes."""
    order = np.lexsort((start, member))
    m, s = member[order], start[order]
    if not len(m):
        return m, s, s
    new = np.ones(len(m), bool)
    new[1:] = (m[1:] != m[:-1]) | (s[1:] > s[:-1] + length)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(m)) - 1
    return m[first], s[first], s[last] + length


def _group_runs(ctx, left: np.ndarray, group: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(member, from, to) of the runs that repeated windows cover in each member's bytes. Members of equal bytes repeat each other
    as a whole; one of them stands for them against the others of its anchor."""
    buf, off = string_bytes(ctx)
    size = np.diff(off)
    whole = mix(Hashed(buf).of(off[:-1], off[1:]) + (group.view(U) + left.astype(U)) * U(0x9E3779B97F4A7C15) + size.astype(U))
    _, first, back, count = np.unique(whole, return_index=True, return_inverse=True, return_counts=True)
    data = buf.tobytes()
    body = lambda i: (int(group[i]), int(left[i]), data[off[i] : off[i + 1]])
    if any(body(i) != body(first[back[i]]) for i in np.flatnonzero(count[back] > 1).tolist()):  # digests that lie
        ids: dict[tuple, int] = {}
        back = np.array([ids.setdefault(body(i), len(ids)) for i in range(len(size))])
        _, first, back, count = np.unique(back, return_index=True, return_inverse=True, return_counts=True)
    again = np.flatnonzero((count[back] > 1) & (size >= length))
    # Anchors that show with one surrounding only are done.
    _, g = np.unique(group[first], return_inverse=True)
    several = np.sort(first[np.bincount(g)[g] > 1])
    pick = np.zeros(len(buf), bool)
    edge = np.zeros(len(buf) + 1, np.int8)
    edge[off[several]] += 1
    edge[off[several + 1]] -= 1
    pick = np.cumsum(edge[:-1], dtype=np.int8) > 0
    m, s = repeated_windows(buf[pick], left[several], size[several], group[several], length)
    m = several[m]
    single = count[back[m]] == 1
    m, a, e = _runs(m[single], s[single], length)
    return np.concatenate([m, again]), np.concatenate([a, np.zeros(len(again), np.int64)]), np.concatenate([e, size[again]])


def _batch(cols, names) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cols], names=names)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    d = docs.select(F.col(quoted(id_col)).alias("id"), F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit("")).alias("text"))
    return d.withColumn("rid", F.xxhash64("id", "text")).withColumn("rid2", F.hash("text", "id"))


def _spans(d: DataFrame, length: int, group: int) -> DataFrame:
    """(rid, rid2, a, b): runs of bytes that repeated windows cover; they may overlap."""
    scratch = Scratch(d.sparkSession)
    gram = max(8, GRAM * length // LENGTH)
    around = length - gram

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, off = string_bytes(b.column(0))
            for i, j in chunks(off, CHUNK):
                at, h, row = anchors(buf[off[i] : off[j]], off[i : j + 1] - off[i], length, gram)
                if len(at):
                    yield _batch([h.view(np.int64), b.column(1).take(pa.array(row + i)), b.column(2).take(pa.array(row + i)), at.astype(np.int32)], ["gram", "rid", "rid2", "pos"])

    found = map_arrow(d.select("text", "rid", "rid2"), find, "gram long, rid long, rid2 int, pos int")
    many = scratch.table(found.groupBy("gram").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "anchors")
    active = found.join(many, "gram").groupBy("rid", "rid2").agg(F.collect_list(F.struct("pos", "gram", "c")).alias("at"))

    # Of equal texts one is enough to meet the others' windows; all of them are removed whole.
    same = d.select("rid", "rid2", F.md5("text").alias("m"), F.octet_length("text").alias("n")).where(F.col("n") >= length)
    salt = F.pmod(F.col("rid"), F.lit(SALTS))
    groups = same.groupBy("m", "n").agg(F.count(F.lit(1)).alias("c"), F.max("rid").alias("top")).where("c > 1").drop("c")
    groups = groups.withColumn("s", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    copies = same.withColumn("s", salt).join(groups, ["m", "n", "s"]).groupBy("rid", "rid2").agg(F.max("n").alias("n"), F.max(F.col("rid") == F.col("top")).alias("keeps"))
    copies = scratch.table(copies, "copies")
    active = active.join(copies.where("not keeps").select("rid", "rid2"), ["rid", "rid2"], "left_anti")

    base = -(-(around + 1) // SLICES)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (key, rid, rid2, begin, stop, left, ctx): text begin to stop is ctx, the anchor is at left; windows in rows of one
        key may be equal. ctx null: the whole stretch is known to be repeated."""
        rows: list[tuple] = []
        seen: dict[tuple, tuple | None] = {}
        for b in batches:
            for i in range(b.num_rows):
                data, rid, rid2 = b.column(0)[i].as_buffer().to_pybytes(), b.column(1)[i].as_py(), b.column(2)[i].as_py()
                at = b.column(3)[i].values
                for x in range(0, len(at), 4096):
                    p = at.slice(x, 4096)
                    for pos, gram, c in zip(p.field("pos").to_pylist(), p.field("gram").to_pylist(), p.field("c").to_pylist(), strict=True):
                        begin, stop = max(pos - around, 0), min(pos + length, len(data))
                        left, ctx = pos - begin, data[begin:stop]
                        if c <= group:
                            rows.append((gram, rid, rid2, begin, stop, left, ctx))
                        elif len(ctx) >= length:
                            rows += hot(seen, (gram, left, ctx), c, (rid, rid2, begin, stop))
                    if len(rows) >= 4096:
                        yield _columns(rows)
                        rows = []
        if rows:
            yield _columns(rows)

    def hot(seen: dict, what: tuple[int, int, bytes], c: int, where: tuple[int, int, int, int]) -> Iterator[tuple]:
        gram, left, ctx = what
        rid, rid2, begin, _ = where
        if what in seen:
            for r in (seen[what], where):
                if r is not None:
                    yield (r[0], *r, 0, None)
            seen[what] = None
            return
        if len(seen) >= REMEMBERED:  # more than one may stand for the rest then
            seen.clear()
        seen[what] = where
        step = max(1, min(base, base * 64 * group // c))
        for near in range(0, around + 1, step):
            far = min(near + step - 1, around)
            lo, hi = max(near, left + length - len(ctx)), min(far, left)  # distances of this text's own windows
            if lo <= hi:
                digit = ctx[left - near : left + length - far] if near <= left else b""
                key = int.from_bytes(hashlib.blake2b(digit, digest_size=8, key=struct.pack("<qi", gram, near)).digest(), "little", signed=True)
                yield (key, rid, rid2, begin + left - hi, begin + left - lo + length, hi, ctx[left - hi : left - lo + length])

    def _columns(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
        return _batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["key", "rid", "rid2", "begin", "stop", "left", "ctx"])

    kind = "key long, rid long, rid2 int, begin int, stop int, left int, ctx binary"
    # The id comes along only to make this exchange of the texts the same as that of the last join, so that it is dealt once.
    text = d.select("rid", "rid2", "text", "id").join(active.hint("shuffle_hash"), ["rid", "rid2"]).select("text", "rid", "rid2", "at", "id")
    windows = map_arrow(text, cut, kind)

    def refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows, last = 0, None
        for b in batches:
            if not b.num_rows:
                continue
            g = b.column(0).to_numpy()
            # Whole anchors only: what belongs to the last one waits for the next batch.
            cut_at = int(np.flatnonzero(g != g[-1])[-1]) + 1 if g[0] != g[-1] else 0
            if held and g[0] != last and rows >= BATCH:
                yield from settle(held)
                held, rows = [], 0
            if cut_at and rows + cut_at >= BATCH:
                yield from settle([*held, b.slice(0, cut_at)])
                held, rows, b = [], 0, b.slice(cut_at)
            held.append(b)
            rows += b.num_rows
            last = g[-1]
        if held:
            yield from settle(held)

    def settle(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held)
        known = t.filter(pc.is_null(t.column(6)))
        if known.num_rows:
            yield from known.select([1, 2, 3, 4]).rename_columns(["rid", "rid2", "a", "b"]).combine_chunks().to_batches()
        t = t.filter(pc.is_valid(t.column(6))).combine_chunks()
        g = t.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(g[1:] != g[:-1]) + 1).tolist(), len(g)] if len(g) else [0]
        i = 0
        while i < len(cuts) - 1:  # a thousand members at a time
            j = i + 1
            while j < len(cuts) - 1 and cuts[j + 1] - cuts[i] <= BATCH:
                j += 1
            p = t.slice(cuts[i], cuts[j] - cuts[i])
            m, a, e = _group_runs(p.column(6), p.column(5).to_numpy().astype(np.int64), p.column(0).to_numpy(), length)
            if len(m):
                begin = p.column(3).to_numpy()[m]
                yield _batch([p.column(1).to_numpy()[m], p.column(2).to_numpy()[m], (begin + a).astype(np.int32), (begin + e).astype(np.int32)], ["rid", "rid2", "a", "b"])
            i = j

    out = map_arrow(windows.repartition("key").sortWithinPartitions("key"), refine, "rid long, rid2 int, a int, b int")
    return out.unionByName(copies.select("rid", "rid2", F.lit(0).alias("a"), F.col("n").alias("b")))


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", group: int = GROUP) -> DataFrame:
    """One row for each row of docs: id_col, n_bytes, n_removed, n_spans, spans array<struct<start, end>>, kept (binary),
    kept_sha256.

    Every byte that a string of `length` bytes covers which also starts anywhere else in docs, in the same text or another, is
    removed; matches do not cross texts; the input decides, not what is left. A null text is empty, texts shorter than length
    are kept whole. Very long texts are searched whole. Rows that repeat id and text repeat each other's windows like any
    copies. A null id is an id like others. An empty table gives no rows; other columns are ignored, whatever their names. Equal
    texts are known by MD5 and length, all other windows by their bytes.
    """
    d = _rows(docs, id_col, text_col)
    s = _spans(d, length, group).groupBy("rid", "rid2").agg(F.collect_list(F.struct("a", "b")).alias("runs"))
    joined = d.select("rid", "rid2", "text", "id").join(s.hint("shuffle_hash"), ["rid", "rid2"], "left").select("id", "text", "runs")
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [id_col, "n_bytes", "n_removed", "n_spans", "spans", "kept", "kept_sha256"]
        for b in batches:
            for x in range(0, b.num_rows, 256):
                p = b.slice(x, 256)
                out = []
                for i in range(p.num_rows):
                    data = p.column(1)[i].as_buffer().to_pybytes()
                    runs = p.column(2)[i]
                    merged: list[list[int]] = []
                    if runs.is_valid:
                        v = runs.values
                        for a, e in sorted(zip(v.field("a").to_pylist(), v.field("b").to_pylist(), strict=True)):
                            if merged and a <= merged[-1][1]:
                                merged[-1][1] = max(merged[-1][1], e)
                            else:
                                merged.append([a, e])
                    at, kept = 0, []
                    for a, e in merged:
                        kept.append(data[at:a])
                        at = e
                    rest = b"".join([*kept, data[at:]])
                    out.append((len(data), len(data) - len(rest), len(merged), [{"start": a, "end": e} for a, e in merged], rest, hashlib.sha256(rest).hexdigest()))
                c = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([p.column(0), *(pa.array(y, pa.int64()) for y in c[:3]), pa.array(c[3], kind), pa.array(c[4], pa.binary()), pa.array(c[5])], names=names)

    id_type = docs.schema[id_col].dataType.simpleString()
    return map_arrow(joined, cut, f"{quoted(id_col)} {id_type}, n_bytes long, n_removed long, n_spans long, spans array<struct<start:long,end:long>>, kept binary, kept_sha256 string")


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its repeated strings of 200 bytes. Null texts are empty; see remove_repeats."""
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
