"""SentencePiece encoding and decoding with the n best segmentations.

The piece lattice of a word has an edge for each vocabulary piece that stands at
a place; a segmentation's score is the sum of its pieces' scores.  A forward
Viterbi pass gives the best score of every prefix; that is the exact heuristic of
a backward A* search from the word's end, which therefore completes
segmentations in order of their scores.

No piece of the vocabulary has a space behind another character (else texts are
not cut), so the lattice of a text is a chain of word lattices, and the n best of
the text come from a best-first search over the words' n best: only the n - 1
words with the smallest loss of their second best can differ from it.

Characters that no piece has are spelled with byte pieces.  Decoding gives the
text back exactly, so a literal U+2581 is spelled with bytes as well.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import kernels as K
from .lattice import Lattice

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: How far a byte piece's score lies below the least score of the vocabulary.
UNKNOWN_PENALTY = 10.0
#: Bounds of a worker's known words (about 150 bytes each besides their own and their ids').
CACHE_WORDS, CACHE_BYTES = 200_000, 1 << 24
#: Words of at most so many bytes are segmented together.
SHORT = 64
NBEST = 4


@dataclass
class Vocabulary:
    """Pieces by text (with spaces as such), byte pieces, and what each id decodes to."""

    pieces: dict[str, tuple[tuple[int], float]]
    bytes_of: list[int]
    spelled: list[bytes]
    unknown: float
    longest: dict[str, int]
    cut: bool  # whether texts are cut in front of spaces, and
    lines: bool  # around line feeds
    lattice: Lattice | None

    @classmethod
    def load(cls, path: str = MODEL) -> Vocabulary:
        """Read a model file (on the driver; executors get the table)."""
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        probe = " a  BéＡ\n x "
        if sp.normalize(probe) != (SPACE + probe).replace(" ", SPACE):
            raise ValueError("only models that keep the text as it is, behind one added space, are supported")
        pieces, bytes_of, spelled = {}, [0] * 256, []
        for i in range(sp.vocab_size()):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                bytes_of[int(p[3:5], 16)] = i
                spelled.append(bytes([int(p[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                spelled.append(b"")
            else:
                text = p.replace(SPACE, " ")
                pieces[text] = ((i,), sp.get_score(i))
                spelled.append(text.encode())
        usual = [s for _, s in pieces.values() if s > -1e8]
        whole = any(" " in p.lstrip(" ") for p in pieces)
        newline = not any("\n" in p for p in pieces)
        longest: dict[str, int] = {}
        for text in pieces:
            for head in (text[:2], text[:3]):
                if len(text) >= 2:
                    longest[head] = max(longest.get(head, 0), len(text))
        unknown = min(usual) - UNKNOWN_PENALTY
        # a zero byte ends words in the lattice; no known model has a piece with one
        lattice = None if any("\0" in p for p in pieces) else Lattice({p: (i, s) for p, ((i,), s) in pieces.items()}, bytes_of, unknown)
        return cls(pieces, bytes_of, spelled, unknown, longest, not whole, newline, lattice)

    def bytes_for(self, char: str) -> tuple[tuple[int, ...], float]:
        """The byte pieces of a character that no piece has (ids backwards, score)."""
        raw = char.encode("utf-8", "surrogatepass")
        return tuple(self.bytes_of[b] for b in reversed(raw)), self.unknown * len(raw)

    def edges(self, word: str) -> list[list[tuple[int, tuple[int, ...], float]]]:
        """By end position: (start, ids backwards, score) of each edge."""
        n, get, reach = len(word), self.pieces.get, self.longest.get
        out: list[list[tuple[int, tuple[int, ...], float]]] = [[] for _ in range(n + 1)]
        for i in range(n):
            out[i + 1].append((i, *(get(word[i]) or self.bytes_for(word[i]))))
            if reach(word[i : i + 2]):
                for j in range(i + 2, min(n, i + (reach(word[i : i + 3]) or 2)) + 1):
                    if hit := get(word[i:j]):
                        out[j].append((i, *hit))
        return out

    def best_and_loss(self, word: str) -> tuple[float, list[tuple[int, ...]], float]:
        """Score and ids (by edge) of the best segmentation, and what the second best loses (over 1e290 if there is none).

        With exact heuristics the backward search leaves the best path once for
        its second answer, so that loss is the least one of a second edge into a
        position on the path; no queue is needed.
        """
        n, get, reach = len(word), self.pieces.get, self.longest.get
        top, second, came = [-1e300] * (n + 1), [-1e300] * (n + 1), [None] * (n + 1)
        top[0] = 0.0
        for i in range(n):
            b = top[i]
            ids, s = get(word[i]) or self.bytes_for(word[i])
            s += b
            j = i + 1
            if s > top[j]:
                second[j], top[j], came[j] = top[j], s, (i, ids)
            elif s > second[j]:
                second[j] = s
            if reach(word[i : i + 2]):
                for j in range(i + 2, min(n, i + (reach(word[i : i + 3]) or 2)) + 1):
                    if hit := get(word[i:j]):
                        s = b + hit[1]
                        if s > top[j]:
                            second[j], top[j], came[j] = top[j], s, (i, hit[0])
                        elif s > second[j]:
                            second[j] = s
        at, path, loss = n, [], 1e299
        while at:
            loss = min(loss, top[at] - second[at])
            at, ids = came[at]
            path.append(ids)
        return top[n], path, loss

    def nbest(self, word: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The n best segmentations: (score, ids), best first; of equal scores, the one whose search gets nearest the start first.

        A path is a pointer to the path that it goes on from, so that a word costs
        memory in proportion to its edges and not to its square.
        """
        edges = self.edges(word)
        best = [0.0]
        for into in edges[1:]:
            top = -1e300
            for i, _, s in into:
                if best[i] + s > top:
                    top = best[i] + s
            best.append(top)
        # (less the best score through it, position, order of insertion, score of the suffix, (ids backwards, path behind it))
        heap = [(-best[-1], len(word), 0, 0.0, None)]
        found: list[tuple[float, tuple[int, ...]]] = []
        push, pop, count = heapq.heappush, heapq.heappop, 0
        while heap:
            cost, at, _, done, path = pop(heap)
            if not at:
                ids: list[int] = []
                while path:
                    ids += path[0][::-1]
                    path = path[1]
                found.append((-cost, tuple(ids)))
                if len(found) == n:
                    break
                continue
            for i, ids_of, s in edges[at]:
                s += done
                count += 1
                push(heap, (-(best[i] + s), i, count, s, (ids_of, path)))
        return found

    def decodes_to(self, ids: np.ndarray, count: np.ndarray, words: list[bytes]) -> np.ndarray:
        """Whether the ids of each word (``count`` of them) spell its bytes."""
        sizes = np.array([len(x) for x in self.spelled], np.int64)
        at = np.append(0, np.cumsum(sizes))
        own = sizes[ids]
        ends = np.append(0, np.cumsum(own))
        place = np.append(0, np.cumsum(count))
        got = np.diff(ends[place])
        same = got == [len(w) for w in words]
        text = np.frombuffer(b"".join(self.spelled), np.uint8)[np.repeat(at[ids] - ends[:-1], own) + np.arange(ends[-1])]
        use = np.repeat(same, got)
        wrong = text[use] != np.frombuffer(b"".join(w for w, s in zip(words, same) if s), np.uint8)
        same[np.repeat(np.arange(len(words)), got)[use][wrong]] = False
        return same

    def decode(self, ids) -> str:
        """The text of a sequence of ids, without the added space."""
        raw = b"".join(map(self.spelled.__getitem__, ids))
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


def packed(ids) -> bytes:
    return struct.pack(f"<{len(ids)}i", *ids)


class Encoder:
    """Segments blocks of texts: each distinct word once, then by gathering from the table of known words.

    The table (best ids, score, what the second best loses, whether the ids decode
    to the word) is emptied between blocks when it exceeds ``CACHE_WORDS`` words or
    ``CACHE_BYTES`` of words and ids.
    """

    def __init__(self, vocabulary: Vocabulary, n: int):
        self.vocabulary, self.n = vocabulary, n
        self._clear()

    def _clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ways: dict[bytes, list[tuple[float, int, bytes]]] = {}
        self.held = self.ways_held = 0
        self.score, self.loss, self.ok = np.zeros(1024), np.zeros(1024), np.zeros(1024, bool)
        self.start, self.ids = np.zeros(1025, np.int64), np.zeros(8192, np.int32)

    def _learn(self, words: list[bytes]) -> None:
        """Add distinct unknown words to the table."""
        v = self.vocabulary
        short = [w for w in words if len(w) <= SHORT] if v.lattice else []
        flat, count, score, loss = v.lattice.best(short) if short else (np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0), np.zeros(0))
        if len(short) < len(words):
            long = [w for w in words if len(w) > SHORT or not v.lattice]
            got = [v.best_and_loss(w.decode()) for w in long]
            ids = [[i for part in path for i in part][::-1] for _, path, _ in got]
            flat = np.concatenate((flat, *[np.array(x, np.int32) for x in ids]))
            count = np.append(count, [len(x) for x in ids])
            score, loss = np.append(score, [s for s, _, _ in got]), np.append(loss, [x for _, _, x in got])
            words = short + long
        at, n = len(self.known), len(words)
        if at + n > len(self.score):
            grown = max(2 * len(self.score), at + n)
            self.score, self.loss, self.ok, self.start = (np.append(x, np.zeros(grown - at, x.dtype)) for x in (self.score[:at], self.loss[:at], self.ok[:at], self.start[: at + 1]))
        a = int(self.start[at])
        b = a + len(flat)
        if b > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros(max(len(self.ids), b - len(self.ids)), np.int32)))
        self.ids[a:b] = flat
        self.start[at + 1 : at + n + 1] = a + np.cumsum(count)
        self.score[at : at + n], self.loss[at : at + n] = score, loss
        self.ok[at : at + n] = v.decodes_to(flat, count, words)
        self.known.update(zip(words, range(at, at + n)))
        self.held += sum(map(len, words)) + 4 * len(flat)

    def _ways(self, word: bytes) -> list[tuple[float, int, bytes]]:
        """The n best segmentations of a word: (score, ids, packed ids)."""
        found = self.ways.get(word)
        if found is None:
            if self.ways_held > CACHE_BYTES // 4:
                self.ways, self.ways_held = {}, 0
            found = self.ways[word] = [(s, len(ids), packed(ids)) for s, ids in self.vocabulary.nbest(word.decode(), self.n)]
            self.ways_held += 200 + len(word) + sum(len(x) for _, _, x in found)
        return found

    def words(self, column: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The words of a block of texts, each behind its added space, and the first word of each text (one more than texts)."""
        buf, offs, _ = K.utf8(column)
        sizes = np.diff(offs)
        sizes += sizes > 0  # the added space
        at = np.zeros(len(sizes) + 1, np.int64)
        np.cumsum(sizes, out=at[1:])
        own = np.ones(at[-1], bool)
        first = at[:-1][sizes > 0]
        own[first] = False
        c = np.full(at[-1], 0x20, np.uint8)
        c[own] = buf
        start = ~own
        if self.vocabulary.cut:
            space = c == 0x20
            line = c == 0x0A if self.vocabulary.lines else np.zeros(len(c), bool)
            start |= line
            start[1:] |= space[1:] & ~space[:-1]
            start[1:] |= line[:-1]
        begins = np.flatnonzero(start)
        ends = np.append(begins, len(c)).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(ends), pa.py_buffer(c)]), np.searchsorted(begins, at)

    def block(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, list[list[tuple[float, int, str]]], np.ndarray]:
        """(ids, first id of each text and the end, by text the n best as (score, ids, sha256), whether each text decodes to itself)."""
        if len(self.known) > CACHE_WORDS or self.held > CACHE_BYTES:
            self._clear()
        words, first = self.words(column)
        coded = words.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if new := [w for w in distinct if w not in self.known]:
            self._learn(new)
        table = np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))
        at = table[np.asarray(coded.indices)] if len(words) else np.zeros(0, np.int64)
        starts = self.start[at]
        sizes = self.start[at + 1] - starts
        ends = np.zeros(len(at) + 1, np.int64)
        np.cumsum(sizes, out=ends[1:])
        flat = self.ids[np.repeat(starts - ends[:-1], sizes) + np.arange(ends[-1])]
        raw = memoryview(flat.astype("<i4").tobytes())
        loss, score, ok = self.loss[at], self.score[at], self.ok[at]
        out, good = [], np.ones(len(first) - 1, bool)
        for text, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
            total = float(score[a:b].sum())
            x, y = int(ends[a]), int(ends[b])
            out.append([(total, y - x, hashlib.sha256(raw[4 * x : 4 * y]).hexdigest())])
            if a < b:
                good[text] = ok[a:b].all()
                if self.n > 1:
                    out[-1] += self._others(total, words, loss, ends, raw, a, b)
        return flat, ends[first], out, good

    def _others(self, total: float, words: pa.Array, loss: np.ndarray, ends: np.ndarray, raw: memoryview, a: int, b: int) -> list[tuple[float, int, str]]:
        """The second to n-th best of a text (words a to b), by best-first search over the words that lose least."""
        own, n = loss[a:b], self.n
        if b - a > n - 1:
            # only n - 1 words can differ: those that lose least, earlier ones first among equals
            near = np.flatnonzero(own <= np.partition(own, n - 2)[n - 2])
            near = near[np.argsort(own[near], kind="stable")][: n - 1].tolist()
        else:
            near = list(range(b - a))
        near = sorted(a + j for j in near if own[j] < 1e290)
        ways = [self._ways(words[j].as_py()) for j in near]
        start = (0,) * len(near)
        heap, seen = [(0.0, start)], {start}
        out: list[tuple[float, int, str]] = []
        while heap and len(out) < n - 1:
            lost, state = heapq.heappop(heap)
            if any(state):
                digest, at, size = hashlib.sha256(), int(ends[a]), int(ends[b] - ends[a])
                for j, w, r in zip(near, ways, state):
                    if r:
                        digest.update(raw[4 * at : 4 * int(ends[j])])
                        digest.update(w[r][2])
                        at = int(ends[j + 1])
                        size += w[r][1] - w[0][1]
                digest.update(raw[4 * at : 4 * int(ends[b])])
                out.append((total - lost, size, digest.hexdigest()))
            for x, w in enumerate(ways):
                r = state[x] + 1
                if r < len(w) and (new := (*state[:x], r, *state[x + 1 :])) not in seen:
                    seen.add(new)
                    heapq.heappush(heap, (lost + w[r - 1][0] - w[r][0], new))
        return out


_encoders: dict[str, Encoder] = {}


def worker_encoder(vocabulary: Vocabulary, model: str, n: int) -> Encoder:
    """This worker's encoder, kept from task to task with the words it knows; one model and n at a time."""
    key = f"{model}|{n}"
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(vocabulary, n)
    return _encoders[key]


ADDED = "ids array<int>, n_tokens long, score double, ids_sha256 string, nbest array<struct<score: double, n_tokens: long, ids_sha256: string>>, round_trip boolean"


def encode(docs: DataFrame, *, text_col: str = "text", model: str = MODEL, nbest: int = NBEST) -> DataFrame:
    """Encode each text by its best segmentation, and state the ``nbest`` best.

    Returns the columns of ``docs`` (input columns with the added names are
    replaced) with ids, n_tokens, score, ids_sha256 (of the ids as little-endian
    32-bit integers), nbest (score, n_tokens and ids_sha256 of each, best first,
    the first being the encoding; fewer if there aren't as many) and round_trip
    (decoding the ids gives the text).

    Null and empty texts have no pieces and one segmentation, the empty one, with
    score 0.  Of equal scores within a word, the one whose search gets nearest the
    word's start first comes first, then the earlier word's; repeated rows get
    equal results; an empty table gives an empty one.  Unspaced texts of any length
    are one word, whose lattice needs about a kilobyte a character.
    """
    K.small_batches(docs.sparkSession)
    vocabulary = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(model))
    docs = docs.drop("ids", "n_tokens", "score", "ids_sha256", "nbest", "round_trip")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), ADDED])

    def run(batches):
        encoder = worker_encoder(vocabulary.value, model, nbest)
        kinds = {"score": pa.float64(), "n_tokens": pa.int64(), "ids_sha256": pa.string()}
        for batch in batches:
            column = batch.column(text_col)
            for i, j in K.doc_blocks(K.utf8(column)[1]):
                part = batch.slice(i, j - i)
                flat, ends, ways, good = encoder.block(part.column(text_col))
                rows = np.zeros(len(ways) + 1, np.int32)
                np.cumsum([len(w) for w in ways], out=rows[1:])
                of = pa.StructArray.from_arrays([pa.array([x[k] for w in ways for x in w], kind) for k, kind in enumerate(kinds.values())], list(kinds))
                first = pa.array(rows[:-1])
                yield pa.record_batch(
                    {name: part.column(name) for name in part.schema.names}
                    | {"ids": pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat)), "n_tokens": of.field("n_tokens").take(first)}
                    | {"score": of.field("score").take(first), "ids_sha256": of.field("ids_sha256").take(first)}
                    | {"nbest": pa.ListArray.from_arrays(pa.array(rows), of), "round_trip": pa.array(good)}
                )

    return docs.mapInArrow(run, schema)


def decode(rows: DataFrame, *, ids_col: str = "ids", text_col: str = "text", model: str = MODEL) -> DataFrame:
    """Replace or add ``text_col`` by the text of ``ids_col``; null ids give a null text."""
    vocabulary = rows.sparkSession.sparkContext.broadcast(Vocabulary.load(model))
    rows = rows.drop(text_col)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields), f"`{text_col}` string"])

    def run(batches):
        for batch in batches:
            texts = [None if ids is None else vocabulary.value.decode(ids) for ids in batch.column(ids_col).to_pylist()]
            yield pa.record_batch({name: batch.column(name) for name in batch.schema.names} | {text_col: pa.array(texts, pa.string())})

    return rows.mapInArrow(run, schema)
