"""SentencePiece encoding and decoding by a streaming Viterbi search.

For each character position the search keeps one backpointer, to the start of the last piece of the best segmentation up to it.
Only positions within the longest piece's length can still be reached, so when the backpointer paths of all of them run through
one boundary, everything before it is final: its ids are committed and the window moves on. The search holds a few times the
longest piece's length of backpointers, whatever the text's length; the text and its ids are held as long as they are, as any row
is. Between two characters that no piece holds side by side all paths meet at once; what the search says of the stretches between
such points is remembered by each task, within bounds, and so is where the search stands after a stretch's first characters: one that
starts alike is searched from there on.

Unigram models take the segmentation of the greatest score. BPE models have one segmentation for each prefix; the last piece of
it is the only one that, joined to the last piece of what precedes it, is left as it is by the merges, so the same search finds
the merges' own result.
"""

from __future__ import annotations

import hashlib
import re
import struct
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import filterfalse
from operator import add
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, map_arrow, quoted, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Stretches that a task remembers at most, in each of two generations, and characters in a stretch that is.
MEMORY, MEMORY_CHARS = 250_000, 48
#: Characters at the start of a stretch up to which the search is remembered, and starts that a task remembers at most.
STEM, STEMS = 6, 100_000
#: Characters whose stretches are looked up at once.
AT_ONCE = 20_000


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer message."""

    def varint(i: int) -> tuple[int, int]:
        x = shift = 0
        while True:
            x |= (data[i] & 127) << shift
            shift += 7
            i += 1
            if data[i - 1] < 128:
                return x, i

    i = 0
    while i < len(data):
        tag, i = varint(i)
        if tag & 7 == 0:
            value, i = varint(i)
        elif tag & 7 == 2:
            n, i = varint(i)
            value, i = data[i : i + n], i + n
        else:
            n = 8 if tag & 7 == 1 else 4
            value, i = data[i : i + n], i + n
        yield tag >> 3, value


class Model:
    """A model file's pieces and the parts of its normalisation that are handled here."""

    def __init__(self, data: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        trainer, norm = {}, {}
        for number, value in _fields(data):
            if number == 1:
                f = dict(_fields(value))
                self.pieces.append((f[1].decode(), struct.unpack("<f", f.get(2, b"\0\0\0\0"))[0], f.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                norm = dict(_fields(value))
        self.bpe = trainer.get(3, 1) == 2
        self.byte_fallback = bool(trainer.get(35, 0))
        self.prefix, self.trim = bool(norm.get(3, 1)), bool(norm.get(4, 1))
        if norm.get(2) or not norm.get(5, 1) or trainer.get(24, 0) or trainer.get(3, 1) not in (1, 2):
            raise NotImplementedError("character maps, white space that is not escaped or is a suffix, word and character models")
        self.unk = next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)
        self.ids = {p: i for i, (p, _, kind) in enumerate(self.pieces) if kind in (NORMAL, USER)}
        self.bytes = [self.unk] * 256
        for i, (p, _, kind) in enumerate(self.pieces):
            if kind == BYTE:
                self.bytes[int(p[3:5], 16)] = i
        self.longest = max(map(len, self.ids), default=1)
        self.least = min((s for _, s, k in self.pieces if k == NORMAL), default=0.0)
        # Whether a space mark only ever starts a piece (or follows another one): then every word is a stretch of its own.
        self.by_word = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids)


class Search:
    """The streaming search over one model; not shared between tasks."""

    def __init__(self, model: Model):
        self.m = model
        self.memory: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.ends: dict[str, tuple[list, list] | None] = {}
        self.joined = {p[i : i + 2] for p in model.ids for i in range(len(p) - 1)}
        self.fit_ids: dict[int, bool] = {}
        # Lengths of the pieces of four and more characters, from the longest, by their last three.
        tails: dict[str, set[int]] = {}
        for p in model.ids:
            if len(p) > 3:
                tails.setdefault(p[-3:], set()).add(len(p))
        self.longer = {t: sorted(x, reverse=True) for t, x in tails.items()}
        self.tails: dict[str, tuple] = {}
        self.stems: dict[str, tuple[list, list, list]] = {}
        self.cut = re.compile(f"[^{SPACE}]{SPACE}")
        self.stretch = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+") if model.by_word else re.compile(r"(?s).+")
        self.widest = 0  # backpointers kept at once, at most

    def merged(self, text: str) -> list[str]:
        """The BPE merges on a short string, one after the other."""
        s = list(text)
        while True:
            best, at = None, -1
            for i in range(len(s) - 1):
                k = self.m.ids.get(s[i] + s[i + 1])
                if k is not None and (best is None or self.m.pieces[k][1] > best):
                    best, at = self.m.pieces[k][1], i
            if at < 0:
                return s
            s[at : at + 2] = [s[at] + s[at + 1]]

    def spines(self, piece: str) -> tuple[list, list] | None:
        """How the merges build a piece: the symbols at its left and at its right end, each as (symbol, rank that made it, rank that
        took it), from the piece itself down to a character. None if they don't build it, or not in the order of rank."""
        if piece in self.ends:
            return self.ends[piece]
        ids, pieces = self.m.ids, self.m.pieces
        nodes: list[tuple] = [(c, -1e30, None, None) for c in piece]
        ordered = True
        while len(nodes) > 1:
            best, at = 1e30, -1
            for i in range(len(nodes) - 1):
                k = ids.get(nodes[i][0] + nodes[i + 1][0])
                if k is not None and -pieces[k][1] < best:
                    best, at = -pieces[k][1], i
            if at < 0:
                break
            x, y = nodes[at : at + 2]
            ordered = ordered and x[1] < best and y[1] < best
            nodes[at : at + 2] = [(x[0] + y[0], best, x, y)]
        out = None
        if len(nodes) == 1 and ordered:
            out = ([], [])
            for side in (0, 1):
                node, taken = nodes[0], 1e30
                while node is not None:
                    out[side].append((node[0], node[1], taken))
                    node, taken = node[2 + side], node[1]
        if len(self.ends) > MEMORY:
            self.ends.clear()
        self.ends[piece] = out
        return out

    def compatible(self, a: str, b: str) -> bool:
        """Whether the merges leave a and b apart when they stand side by side; each is one piece or one character."""
        left, right = self.spines(a) if a else None, self.spines(b)
        if right is None or (a and left is None):
            return self.merged(a + b) == [a, b] if a else self.merged(b) == [b]
        if not a:
            return True
        ids, pieces = self.m.ids, self.m.pieces
        x, y, i, j = left[1], right[0], 0, 0
        while True:
            # x[i] and y[j] stand side by side until one of them is taken; of equal ranks the left one goes first.
            k = ids.get(x[i][0] + y[j][0])
            if k is not None and -pieces[k][1] < x[i][2] and -pieces[k][1] <= y[j][2]:
                return False
            if x[i][1] > y[j][1]:
                i += 1
            elif j + 1 < len(y):
                j += 1
            elif i + 1 < len(x):
                i += 1
            else:
                return True

    def string(self, x: int) -> str:
        """The piece or unknown character x of a path."""
        size = len(self.m.pieces)
        return self.m.pieces[x][0] if x < size else "" if x == size else chr(x - size - 1)

    def ending(self, tail: str) -> tuple:
        """The last pieces that a text ending in tail (its last three characters, or all it has) can have, from the longest: each as
        (length, id), the id -1 if it depends on more than tail."""
        out = [(k, -1) for k in self.longer.get(tail, ())]
        out += [(k, x) for k in range(len(tail), 0, -1) if (x := self.m.ids.get(tail[-k:], len(self.m.pieces) + 1 + ord(tail[-1]) if k == 1 else None)) is not None]
        if len(self.tails) > MEMORY:
            self.tails.clear()
        self.tails[tail] = found = tuple(out)
        return found

    def segments(self, text: str) -> Iterator[list[int]]:
        """The pieces of a stretch in order, each as soon as it is certain; unknown characters by len(pieces) + 1 + code point."""
        size, longest, get, bpe = len(self.m.pieces), self.m.longest, self.m.ids.get, self.m.bpe
        tails, fits, room = self.tails, self.fit_ids, 4 * longest + 2
        # Of position base + i: start and id of its last piece, and for unigram models the score.
        base, back, last, score = 0, [0], [size], [0.0]
        # The search has been the same up to there for each text that starts alike.
        if stem := self.stems.get(text[:STEM]) if len(text) > STEM else None:
            back, last, score = stem[0][:], stem[1][:], stem[2][:]
        for end in range(len(back), len(text) + 1):
            if bpe:  # the one last piece that the merges leave in text[:end]
                tail = text[end - 3 : end] if end > 2 else text[:end]
                try:
                    ending = tails[tail]
                except KeyError:
                    ending = self.ending(tail)
                for k, x in ending:
                    if (start := end - k) < base or (x < 0 and (x := get(text[start:end], -1)) < 0):
                        continue
                    pair = last[start - base] << 22 | x
                    try:
                        ok = fits[pair]
                    except KeyError:
                        if len(fits) > 2 * MEMORY:
                            fits.clear()
                        ok = fits[pair] = self.compatible(self.string(last[start - base]), text[start:end])
                    if ok:
                        break
                # Where none fits, the last of them is the character itself.
            else:  # the last piece of the segmentation of text[:end] of the greatest score
                start, x, top = end - 1, size + 1 + ord(text[end - 1]), -1e30
                for at in range(max(base, end - longest), end):
                    if (y := get(text[at:end])) is not None:
                        s = self.m.pieces[y][1] if self.m.pieces[y][2] != USER else longest * 10.0
                    elif end - at == 1:
                        y, s = size + 1 + ord(text[at]), self.m.least - 10
                    else:
                        continue
                    if score[at - base] + s > top:
                        start, x, top = at, y, score[at - base] + s
                score.append(top)
            back.append(start)
            last.append(x)
            if end == STEM < len(text):
                if len(self.stems) >= STEMS:
                    self.stems.clear()
                self.stems[text[:STEM]] = back[:], last[:], score[:]
            if end - base > room:
                self.widest = max(self.widest, len(back))
                # All paths that can still grow start at the last `longest` positions; where they meet, the past is certain.
                live = set(range(end - longest + 1, end + 1))
                while len(live) > 1:
                    live.discard(at := max(live))
                    live.add(back[at - base] if at > base else base)
                meet = live.pop()
                if meet > base:
                    yield self._walk(back, last, base, meet)
                    back, last, score = back[meet - base :], last[meet - base :], score[meet - base :]
                    base = meet
        self.widest = max(self.widest, len(back))
        yield self._walk(back, last, base, len(text))

    @staticmethod
    def _walk(back: list[int], last: list[int], base: int, end: int) -> list[int]:
        out = []
        while end > base:
            out.append(last[end - base])
            end = back[end - base]
        return out[::-1]

    def ids_of(self, stretch: str) -> bytes:
        size, out, unknown = len(self.m.pieces), array("i"), False
        for run in self.segments(stretch):
            if max(run, default=0) < size:
                out.fromlist(run)
                unknown = unknown and not run
                continue
            for x in run:
                if x < size:
                    out.append(x)
                elif self.m.byte_fallback:
                    out.extend([self.m.bytes[b] for b in chr(x - size - 1).encode()])
                elif not unknown:  # unknown neighbours are one
                    out.append(self.m.unk)
                unknown = x >= size
        return out.tobytes()

    def _parted(self, stretch: str) -> bytes:
        """A stretch cut where no piece holds both neighbours."""
        held = [*map(self.joined.__contains__, map(add, stretch, stretch[1:]))]
        if all(held) or not self.m.byte_fallback:
            return self.ids_of(stretch)
        cuts, out = [i for i, x in enumerate(held, 1) if not x], []
        for i, j in zip([0, *cuts], [*cuts, len(stretch)], strict=True):
            s = stretch[i:j]
            if (x := self.memory.get(s)) is None:
                if (x := self.older.get(s)) is None:
                    x = self.ids_of(s)
                if len(s) <= MEMORY_CHARS and len(self.memory) < MEMORY:
                    self.memory[s] = x
            out.append(x)
        return b"".join(out)

    def encode(self, text: str) -> np.ndarray:
        if self.m.trim:
            text = re.sub(" +", " ", text.strip(" "))
        if not text:
            return np.zeros(0, np.int32)
        text = text.replace(" ", SPACE)
        if self.m.prefix:
            text = SPACE + text
        start, out = 0, []
        while start < len(text):
            # Stretches of so many characters at once, cut where one ends; all of them if they are no words.
            end = self.cut.search(text, start + AT_ONCE) if self.m.by_word else None
            end = end.end() - 1 if end else len(text)
            stretches = self.stretch.findall(text, start, end)
            start, new = end, {s: self._remembered(s) for s in filterfalse(self.memory.__contains__, stretches)}
            try:
                out.append(b"".join(map(self.memory.__getitem__, stretches)))
            except KeyError:  # one is too long to be remembered, or the memory has just become the older one
                out.append(b"".join([new[s] if s in new else self._remembered(s) for s in stretches]))
        return np.frombuffer(b"".join(out), np.int32)

    def _remembered(self, s: str) -> bytes:
        """The ids of a stretch that the newer memory lacked."""
        if (x := self.memory.get(s)) is None:
            if (x := self.older.get(s)) is None:
                x = self._parted(s)
            if len(s) <= MEMORY_CHARS:
                if len(self.memory) >= MEMORY:
                    self.older, self.memory = self.memory, {}
                self.memory[s] = x
        return x


class Decoder:
    def __init__(self, model: Model):
        self.m = model
        self.raw = [b"" if k == CONTROL else bytes([int(p[3:5], 16)]) if k == BYTE else " ⁇ ".encode() if k == UNKNOWN else p.replace(SPACE, " ").encode() for p, _, k in model.pieces]

    def decode(self, ids: np.ndarray) -> str:
        raw = self.raw
        text = b"".join(map(raw.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if self.m.prefix and text.startswith(" ") else text


@lru_cache(4)
def _search(path: str, data: bytes) -> Search:
    return Search(Model(data))


def encode(docs: DataFrame, model_path: str = MODEL, text_col: str = "text", check: bool = False) -> DataFrame:
    """docs with a column piece_ids (underscored where taken), array<int>, all other columns as they came, whatever their names; with
    check also a struct column piece_check: the
    SHA-256 of the decoded text, and whether it equals the text (a text that holds the space mark itself, or is trimmed by the
    model, does not come back). A null or empty text has no ids; very long ones are searched in a bounded window; repeated
    rows alike; an empty table gives no rows. The model file is read by the driver and sent to the tasks."""
    data = Path(model_path).read_bytes()
    Model(data)
    held = docs.sparkSession.sparkContext.broadcast(data)
    names = fresh(docs, "piece_ids", "piece_check")[: 1 + check]
    n, columns = len(docs.columns), [*docs.columns, *names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = _search(model_path, held.value)
        decoder = Decoder(search.m)
        for b in batches:
            for x in range(0, b.num_rows, 256):
                p = b.slice(x, 256)
                texts = [t or "" for t in p.column(n).to_pylist()]
                ids = [search.encode(t) for t in texts]
                off = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
                cols = [*p.columns[:n], pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate([*ids, np.zeros(0, np.int32)])))]
                if check:
                    back = [decoder.decode(i) for i in ids]
                    cols.append(pa.StructArray.from_arrays([pa.array([hashlib.sha256(t.encode()).hexdigest() for t in back]), pa.array([t == u for t, u in zip(back, texts, strict=True)])], ["sha256", "same"]))
                yield pa.RecordBatch.from_arrays(cols, names=columns)

    wide = docs.select(*[F.col(quoted(c)) for c in docs.columns], F.col(quoted(text_col)).cast("string").alias(fresh(docs, "piece_text")[0]))
    kinds = ["array<int>", "struct<sha256:string,same:boolean>"]
    return map_arrow(wide, run, T.StructType([*docs.schema, *(T.StructField(c, T.DataType.fromDDL(k)) for c, k in zip(names, kinds, strict=False))]))


def decode(rows: DataFrame, model_path: str = MODEL, ids_col: str = "piece_ids") -> DataFrame:
    """rows with a string column piece_text (underscored where taken), the text of the ids, all other columns as they
    came. Null or no ids give an empty text, a null among the ids nothing; bytes that are no UTF-8 become U+FFFD; very long rows are
    decoded whole, repeated rows alike; an empty table gives no rows."""
    held = rows.sparkSession.sparkContext.broadcast(Path(model_path).read_bytes())
    (name,) = fresh(rows, "piece_text")
    n, columns = len(rows.columns), [*rows.columns, name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(_search(model_path, held.value).m)
        for b in batches:
            text = [decoder.decode(np.array([x for x in i or [] if x is not None], np.int32)) for i in b.column(n).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(text, pa.string())], names=columns)

    wide = rows.select(*[F.col(quoted(c)) for c in rows.columns], F.col(quoted(ids_col)).alias(name))
    return map_arrow(wide, run, T.StructType([*rows.schema, T.StructField(name, T.StringType())]))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, with the round trip. Null and empty texts have none; see encode."""
    d = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), check=True)
    return d.select("doc_id", "piece_ids", F.size("piece_ids").cast("long").alias("n_ids"), F.col("piece_check.sha256").alias("decoded_sha256"), F.col("piece_check.same").alias("round_trip"))
