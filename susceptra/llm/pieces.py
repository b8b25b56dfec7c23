"""SentencePiece encoding and decoding; giant documents by a max-plus parallel scan.

A tokenization is a path through the text's lattice of pieces. Unigram models weigh a path by its pieces' scores. For BPE
models a path is the encoding exactly if each two neighbours, merged on their own, come apart as they are; so neighbours
weigh 0 or minus infinity and the best path is SentencePiece's own result.

Texts of up to CHUNK characters are encoded whole by the library. Longer ones are cut into chunks at any character:
1. each chunk, on its own, gives the max-plus transfer matrix from the pieces that may cover its left boundary to those
   that may cover its right one (kept as its finite entries);
2. the matrices of a document are combined associatively, as a tree, down to the pieces on the boundaries of the best path;
3. each chunk, on its own again, is traced back between its two boundary pieces.
Between resets - places that no piece spans, as before a space - nothing depends on the boundaries, and the library encodes
those stretches; the lattice is only walked between a boundary and the nearest reset.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType
from sentencepiece import sentencepiece_model_pb2

from susceptra.storage import bounded_batches, materialise

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
CHUNK = 1 << 15
SPACE = "▁"
UNIGRAM, BPE = 1, 2
NONE = -np.inf
#: Neighbours remembered as fitting or not, and rows of a batch that are Python objects at a time: workers stay small.
PAIRS, ROWS = 100_000, 16
#: A state: the piece that covers a boundary or ends there, as (start, end, id), counted from the chunk's first character.
State = tuple[int, int, int]


class Vocabulary:
    """A model's pieces, and the weights of single pieces and of neighbours. Unknown characters have id -1."""

    def __init__(self, model: bytes):
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        self.kind, norm = proto.trainer_spec.model_type, proto.normalizer_spec
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are read")
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("a model that rewrites its input or puts spaces last is not read")
        self.prefix = norm.add_dummy_prefix
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type in (1, 4)}
        self.scores = {i: p.score for i, p in enumerate(proto.pieces)}
        self.names = {i: p for p, i in self.ids.items()}
        self.longest = max(map(len, self.ids))
        self.bytes_of = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == 6}
        self.unknown = next(i for i, p in enumerate(proto.pieces) if p.type == 2)
        self.worst = min(p.score for p in proto.pieces if p.type == 1) - 10.0
        # a space starts pieces and is never inside one behind another character: then every such place is a reset
        self.space_resets = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self.line_end_unknown = "\n" not in self.ids and "\n" not in {c for p in self.ids for c in p}
        raw = []
        for i, p in enumerate(proto.pieces):
            raw.append(bytes([int(p.piece[3:5], 16)]) if p.type == 6 else " ⁇ ".encode() if p.type == 2 else b"" if p.type == 3 else p.piece.replace(SPACE, " ").encode())
        self.bytes = pa.array(raw, pa.binary())
        self._pairs: dict[tuple[int, int], bool] = {}

    def normal(self, text: str) -> str:
        return ((" " if self.prefix and text else "") + text).replace(" ", SPACE)

    def merged(self, s: str) -> list[str]:
        """BPE of a short string: the best-scored neighbours merge first, the leftmost of equals."""
        parts = list(s)
        while True:
            best = max(((self.scores[i], -k) for k in range(len(parts) - 1) if (i := self.ids.get(parts[k] + parts[k + 1])) is not None), default=None)
            if best is None:
                return parts
            k = -best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    def fits(self, left: int, right: int) -> bool:
        """May the two pieces stand side by side?"""
        if self.kind == UNIGRAM or right < 0 and left < 0:
            return True
        key = (left, right)
        if (known := self._pairs.get(key)) is None:
            a, b = self.names.get(left, ""), self.names.get(right, "")
            known = self.merged(a + b) == [x for x in (a, b) if x] if a and b else self.merged(a or b) == [a or b]
            if len(self._pairs) >= PAIRS:
                self._pairs.clear()
            self._pairs[key] = known
        return known

    def weight(self, piece: int) -> float:
        return 0.0 if self.kind == BPE else self.scores[piece] if piece >= 0 else self.worst

    def emit(self, s: str, piece: int) -> list[int]:
        if piece >= 0:
            return [piece]
        if not self.bytes_of:
            return [self.unknown]
        return [self.bytes_of[b] for b in s.encode("utf-8", "surrogatepass")]

    def pieces_at(self, s: str, at: int) -> list[State]:
        """The lattice's arcs from a place: its pieces, or the character itself where it is unknown."""
        found = [(at, end, i) for end in range(at + 1, min(len(s), at + self.longest) + 1) if (i := self.ids.get(s[at:end])) is not None]
        return found if found and found[0][1] == at + 1 else [(at, at + 1, -1), *found]

    def is_reset(self, s: str, at: int) -> bool:
        """No piece spans this place, and what stands on either side is encoded the same on its own."""
        if at <= 0 or at >= len(s):
            return True
        left, right = s[at - 1], s[at]
        if self.line_end_unknown and "\n" in (left, right):
            return True
        return self.space_resets and right == SPACE and left != SPACE

    def covering(self, s: str, at: int) -> list[State]:
        """All states of a boundary: pieces that start before it and end at or behind it."""
        return [p for start in range(max(0, at - self.longest + 1), at) for p in self.pieces_at(s, start) if p[1] >= at]


@lru_cache(maxsize=2)
def vocabulary(model: bytes) -> Vocabulary:
    return Vocabulary(model)


def walk(v: Vocabulary, s: str, first: State | None, at: int, stop: int) -> dict[State, tuple[float, State | None]]:
    """Best weights from a state (or from a reset at `at`) to every piece that starts before stop, with each one's predecessor.

    Pieces that end where no further piece starts before stop are the outcomes; all others are on the way.
    """
    best: dict[State, tuple[float, State | None]] = {}
    ends: dict[int, list[State]] = {}
    if first is not None:
        best[first] = (0.0, None)
        ends[first[1]] = [first]
    for place in range(at, stop):
        before = ends.get(place, [])
        if not before and not (first is None and place == at):
            continue
        for arc in v.pieces_at(s, place):
            options = [(best[p][0], p) for p in before if v.fits(p[2], arc[2])] if before else [(0.0, None)] if v.fits(arc[2], -1) else []
            if options:
                weight, origin = max(options, key=lambda o: (o[0], o[1] or (0, 0, 0)))
                best[arc] = (weight + v.weight(arc[2]), origin)
                ends.setdefault(arc[1], []).append(arc)
    return best


def trace(best: dict[State, tuple[float, State | None]], last: State, first: State | None) -> list[State]:
    path = []
    now: State | None = last
    while now is not None and now != first:
        path.append(now)
        now = best[now][1]
    return path[::-1]


def resets(v: Vocabulary, s: str, a: int, b: int) -> tuple[int, int] | None:
    """The first and the last reset from a to b, or None."""
    one = next((i for i in range(a, b + 1) if v.is_reset(s, i)), None)
    return None if one is None else (one, next(i for i in range(b, one - 1, -1) if v.is_reset(s, i)))


def stretch(v: Vocabulary, s: str) -> list[int]:
    """Ids of a stretch between two resets (or of a whole normalised text), by the library."""
    if not s:
        return []
    if v.prefix and s[0] == SPACE:
        return v.library.encode(s[1:].replace(SPACE, " ")) if s != SPACE else [v.ids[SPACE]]
    if v.line_end_unknown:
        lead = len(v.library.encode("\n"))
        return v.library.encode("\n" + s.replace(SPACE, " "))[lead:]
    return v.library.encode(s.replace(SPACE, " "))


def transfer(v: Vocabulary, s: str, a: int, b: int, start: bool) -> list[tuple[State, State, float]]:
    """Finite entries of the max-plus matrix of the chunk [a, b) of s, which has its neighbours' characters around it."""
    ins = [(a, a, -2)] if start else v.covering(s, a)
    found = resets(v, s, a, b)
    entries = []
    if found is None:
        for state in ins:
            best = walk(v, s, None if start else state, state[1], b)
            entries += [(state, o, w) for o, (w, _) in best.items() if o[0] < b <= o[1] and o != state]
        return entries
    one, last = found
    heads = []
    for state in ins:
        if state[1] > one:
            continue
        if state[1] == one:
            heads.append((state, 0.0))
            continue
        best = walk(v, s, None if start else state, state[1], one)
        ends = [w for o, (w, _) in best.items() if o[1] == one]
        if ends:
            heads.append((state, max(ends)))
    if one == last == b:
        # the reset is the right boundary itself: outcomes are the pieces that end there
        for state, _ in heads:
            best = walk(v, s, None if start else state, state[1], b)
            entries += [(state, o, w) for o, (w, _) in best.items() if o[1] == b]
        return entries
    middle, cut = 0.0, last
    if v.kind == UNIGRAM:
        best = walk(v, s, None, one, last)
        middle = max([w for o, (w, _) in best.items() if o[1] == last], default=0.0)
    if last == b:
        # end the middle one reset earlier, so that the piece on the right boundary is known
        cut = next(i for i in range(b - 1, one - 1, -1) if v.is_reset(s, i)) if any(v.is_reset(s, i) for i in range(one, b)) else one
    best = walk(v, s, None, cut, b)
    if v.kind == UNIGRAM and cut != last:
        inner = walk(v, s, None, one, cut)
        middle = max([w for o, (w, _) in inner.items() if o[1] == cut], default=0.0)
    tails = [(o, w) for o, (w, _) in best.items() if o[1] >= b]
    return [(i, o, h + middle + w) for i, h in heads for o, w in tails]


def combine(left: list[tuple[State, State, float]], right: list[tuple[State, State, float]], length: int) -> list[tuple[State, State, float]]:
    """Max-plus product. Right states count from the right chunk's start, `length` characters behind the left one's."""
    by_state: dict[State, list[tuple[State, float]]] = {}
    for i, o, w in right:
        by_state.setdefault((i[0] + length, i[1] + length, i[2]), []).append((o, w))
    out: dict[tuple[State, State], float] = {}
    for i, o, w in left:
        for far, more in by_state.get(o, ()):
            key = (i, (far[0] + length, far[1] + length, far[2]))
            out[key] = max(out.get(key, NONE), w + more)
    return [(i, o, w) for (i, o), w in out.items()]


def boundaries(matrices: list[list[tuple[State, State, float]]], lengths: list[int]) -> list[tuple[State, State]]:
    """The states (in, out) of every chunk on the best path, each counted from its chunk's start."""
    tree = [list(zip(matrices, lengths, strict=True))]
    while len(tree[-1]) > 1:
        level = tree[-1]
        tree.append([(combine(level[i][0], level[i + 1][0], level[i][1]), level[i][1] + level[i + 1][1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)])
    whole = tree[-1][0][0]
    if not whole:
        raise ValueError("no path through the document")
    top = max(whole, key=lambda e: (e[2], e[0], e[1]))
    wanted = [(top[0], top[1])]
    for level in reversed(tree[:-1]):
        below = []
        for k, (first, last) in enumerate(wanted):
            if 2 * k + 1 >= len(level):
                below.append((first, last))
                continue
            (left, n), (right, _) = level[2 * k], level[2 * k + 1]
            target = (last[0] - n, last[1] - n, last[2])
            onward = {(i[0] + n, i[1] + n, i[2]): w for i, o, w in right if o == target}
            middle = max(((w + onward[o], o) for i, o, w in left if i == first and o in onward))[1]
            below += [(first, middle), ((middle[0] - n, middle[1] - n, middle[2]), target)]
        wanted = below
    return wanted


def backtrace(v: Vocabulary, s: str, a: int, b: int, first: State, last: State, start: bool) -> list[int]:
    """Ids of the pieces that start in [a, b), between the boundary states: `first` belongs to the chunk before."""
    origin = None if start else first
    found = resets(v, s, first[1], last[0])
    if found is None:
        path = trace(walk(v, s, origin, first[1], b), last, origin)
        return [i for p in path for i in v.emit(s[p[0] : p[1]], p[2])]
    one, stop = found
    out: list[int] = []
    if first[1] < one:
        best = walk(v, s, origin, first[1], one)
        ends = {o: w for o, (w, _) in best.items() if o[1] == one and o != origin}
        head = trace(best, max(ends, key=lambda o: (ends[o], o)), origin)
        out += [i for p in head for i in v.emit(s[p[0] : p[1]], p[2])]
    out += stretch(v, s[one:stop])
    tail = trace(walk(v, s, None, stop, b), last, None)
    return out + [i for p in tail for i in v.emit(s[p[0] : p[1]], p[2])]


def scan_encode(v: Vocabulary, text: str, chunk: int = CHUNK) -> list[int]:
    """The three steps on one machine: what encode does to a giant document with one task per chunk."""
    s = v.normal(text)
    if not s:
        return []
    # a last chunk shorter than two pieces joins the one before it
    cuts = list(range(0, max(1, len(s) - 2 * v.longest), chunk))
    jobs = [_window(v, s, c, n) for c, n in zip(cuts, [*cuts[1:], len(s)], strict=True)]
    matrices = [_shift(transfer(v, *j), -j[1]) for j in jobs]
    found = boundaries(matrices, [j[2] - j[1] for j in jobs])
    return [i for j, (x, y) in zip(jobs, found, strict=True) for i in backtrace(v, *j[:3], _moved(x, j[1]), _moved(y, j[1]), j[3])]


def _moved(s: State, by: int) -> State:
    return (s[0] + by, s[1] + by, s[2])


def _shift(entries: list[tuple[State, State, float]], by: int) -> list[tuple[State, State, float]]:
    return [(_moved(i, by), _moved(o, by), w) for i, o, w in entries]


def _window(v: Vocabulary, s: str, a: int, b: int) -> tuple[str, int, int, bool]:
    """A chunk with the characters around it that pieces over its boundaries can reach."""
    low, high = max(0, a - 2 * v.longest), min(len(s), b + 2 * v.longest)
    return s[low:high], a - low, b - low, a == 0


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """The batch's rows as dictionaries, ROWS of them made at a time."""
    for i in range(0, batch.num_rows, ROWS):
        yield from batch.slice(i, ROWS).to_pylist()


def _pack(ids: list[int]) -> bytes:
    return np.asarray(ids, "<i4").tobytes()


def encode(docs: DataFrame, model: bytes, key: str = "doc_id", text: str = "text", chunk: int = CHUNK, digest: bool = False) -> DataFrame:
    """(key, text) -> (key, n_tokens, ids): ids are little-endian 32-bit numbers. digest adds decoded_sha256, of the text decoded from the ids.

    Null and empty texts have no tokens. Rows equal in key and text give equal rows. The model, whose size is that of a
    vocabulary, travels inside the function. No rows give no rows.
    """
    bounded_batches(docs.sparkSession)
    source = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))

    names, kind = ["key", "n_tokens", "ids"], source.select("key").schema.add("n_tokens", "long").add("ids", "binary")
    if digest:
        names, kind = [*names, "decoded_sha256"], kind.add("decoded_sha256", "string")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model)
        for b in batches:
            for part in (b.slice(i, 64) for i in range(0, b.num_rows, 64)):
                texts = part.column("text").to_pylist()
                short = [t for t in texts if len(t) <= chunk]
                made = iter(v.library.encode(short, num_threads=1) if short else [])
                ids = [next(made) if len(t) <= chunk else None for t in texts]
                packed = pa.array([None if i is None else _pack(i) for i in ids], pa.binary())
                extra = [pa.array([hashlib.sha256(t.encode()).hexdigest() for t in decode_ids(v, packed)])] if digest else []
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array([None if i is None else len(i) for i in ids], pa.int64()), packed, *extra], names)

    small = source.filter(F.length("text") <= chunk).mapInArrow(whole, kind)
    giant = source.filter(F.length("text") > chunk)
    v = vocabulary(model)
    halo = 2 * v.longest
    lead = 1 if v.prefix else 0
    long_text = F.translate(F.concat(F.lit(SPACE if lead else ""), F.col("text")), " ", SPACE)
    numbered = giant.select("key", F.xxhash64("text").alias("row"), long_text.alias("s")).dropDuplicates(["key", "row"]).withColumn("n", F.length("s"))
    starts = numbered.withColumn("at", F.explode(F.sequence(F.lit(0), F.greatest(F.col("n") - halo - 1, F.lit(0)), F.lit(chunk))))
    low = F.greatest(F.col("at") - halo, F.lit(0))
    stop = F.when(F.col("at") + chunk < F.col("n") - halo, F.col("at") + chunk).otherwise(F.col("n"))
    windows = starts.select("key", "row", "at", (F.col("at") - low).alias("a"), (stop - low).alias("b"), F.substring(F.col("s"), low + 1, stop - low + halo).alias("s"))
    windows = materialise(windows.repartition("key", "row", "at"), "chunks")

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model)
        for b in batches:
            packed = []
            for r in _rows(b):
                entries = _shift(transfer(v, r["s"], r["a"], r["b"], r["at"] == 0), -r["a"])
                packed.append(np.array([(*i, *o, w) for i, o, w in entries], np.float64).tobytes())
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("row"), b.column("at"), pa.compute.subtract(b.column("b"), b.column("a")).cast(pa.int64()), pa.array(packed, pa.binary())], ["key", "row", "at", "length", "matrix"])

    def path(group: pa.Table) -> pa.Table:
        group = group.sort_by("at")
        unpacked = []
        for m in group.column("matrix"):
            rows = np.frombuffer(m.as_py(), np.float64).reshape(-1, 7).tolist()
            unpacked.append([(tuple(map(int, r[:3])), tuple(map(int, r[3:6])), r[6]) for r in rows])
        found = boundaries(unpacked, group.column("length").to_pylist())
        return pa.table({"key": group.column("key"), "row": group.column("row"), "at": group.column("at"), "first": pa.array([list(x) for x, _ in found], pa.list_(pa.int64())), "last": pa.array([list(y) for _, y in found], pa.list_(pa.int64()))})

    keyed = source.select("key").schema.add("row", "long").add("at", "integer")
    scanned = windows.mapInArrow(matrices, source.select("key").schema.add("row", "long").add("at", "integer").add("length", "long").add("matrix", "binary"))
    states = scanned.groupBy("key", "row").applyInArrow(path, keyed.add("first", ArrayType(LongType())).add("last", ArrayType(LongType())))

    def traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model)
        for b in batches:
            out = []
            for r in _rows(b):
                out.append(_pack(backtrace(v, r["s"], r["a"], r["b"], _moved(tuple(r["first"]), r["a"]), _moved(tuple(r["last"]), r["a"]), r["at"] == 0)))
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("row"), b.column("at"), pa.array(out, pa.binary())], ["key", "row", "at", "ids"])

    w, t = windows.alias("w"), states.alias("t")
    placed = w.join(t, F.col("w.key").eqNullSafe(F.col("t.key")) & (F.col("w.row") == F.col("t.row")) & (F.col("w.at") == F.col("t.at"))).select("w.*", "t.first", "t.last")
    parts = placed.mapInArrow(traced, source.select("key").schema.add("row", "long").add("at", "integer").add("ids", "binary"))
    joined = parts.groupBy("key", "row").agg(F.array_sort(F.collect_list(F.struct("at", "ids"))).alias("p"))
    joined = joined.select("key", "row", F.unhex(F.array_join(F.transform("p", lambda x: F.hex(x["ids"])), "")).alias("ids"))
    g, j = giant.select("key", F.xxhash64("text").alias("row")).alias("g"), joined.alias("j")
    large = g.join(j, F.col("g.key").eqNullSafe(F.col("j.key")) & (F.col("g.row") == F.col("j.row"))).select("g.key", (F.length("j.ids") / 4).cast("long").alias("n_tokens"), "j.ids")
    if digest:
        large = decode(large, model, ["key", "n_tokens", "ids"]).select("key", "n_tokens", "ids", F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))
    return small.unionByName(large).withColumnRenamed("key", key)


def decode_ids(v: Vocabulary, ids: pa.Array) -> list[str]:
    """Texts of packed ids: pieces are taken from one byte table and joined; the dummy prefix goes; bad UTF-8 is replaced."""
    packed = [x.as_py() or b"" for x in ids]
    flat = np.frombuffer(b"".join(packed), "<i4")
    ends = np.concatenate(([0], np.cumsum([len(p) // 4 for p in packed]))).astype(np.int32)
    taken = v.bytes.take(pa.array(flat))
    offsets = np.frombuffer(taken.buffers()[1], np.int32)[: len(flat) + 1]
    data = taken.buffers()[2].to_pybytes() if len(flat) else b""
    cut = 1 if v.prefix else 0
    out = []
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        raw = data[offsets[a] : offsets[b]] if b > a else b""
        out.append((raw[cut:] if cut and raw[:1] == b" " else raw).decode("utf-8", "replace"))
    return out


def decode(rows: DataFrame, model: bytes, keep: list[str], ids: str = "ids") -> DataFrame:
    """The kept columns plus decoded, the text of packed ids. Null ids decode to the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model)
        for b in batches:
            for part in (b.slice(i, 512) for i in range(0, b.num_rows, 512)):
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], pa.array(decode_ids(v, part.column(ids)), pa.string())], [*keep, "decoded"])

    return rows.select(*keep, ids).mapInArrow(run, rows.select(*keep).schema.add("decoded", "string")) if ids not in keep else rows.select(*keep).mapInArrow(run, rows.select(*keep).schema.add("decoded", "string"))


def encoded_digests(docs: DataFrame, model_path: str = MODEL) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the ids as little-endian 32-bit numbers) and decoded_sha256 (of the text decoded from them).

    The model is read once by the driver and travels with the code. Other columns are ignored.
    """
    with open(model_path, "rb") as f:
        model = f.read()
    rows = encode(docs.select("doc_id", "text"), model, digest=True)
    return rows.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), "decoded_sha256")
