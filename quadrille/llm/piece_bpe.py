"""SentencePiece encoding and decoding by a merge-type prefix table.

For every prefix of a chunk the table stores the one token that ends the encoding of that
prefix. It is found among the automaton's matches that end there: a token fits if it is compatible
with the stored token of the prefix before it, that is, if the two next to each other are what
merging their joined text would leave. The ids are then read off backwards. Texts are cut
into chunks only where no piece of the vocabulary holds the two characters side by side, so
no merge can cross a cut.
"""

from __future__ import annotations

import hashlib
import re
from array import array

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"


STEP = 1000
LONG = 24
_PART = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


class ChunkCache(dict):
    """Chunk -> its ids as packed 16-bit numbers, in two generations of at most `bound` chunks."""

    def __init__(self, coder: "PieceTable", bound: int):
        super().__init__()
        self.coder, self.bound, self.old = coder, bound, {}

    def __missing__(self, text: str) -> bytes:
        got = self.old.get(text)
        if got is None:
            cut = len(text)
            while cut and not text[cut - 1].isalnum() and text[cut - 1] != SPACE:
                cut -= 1
            if 0 < cut < len(text) and text[cut - 1] != SPACE and text[cut - 1 : cut + 1] not in self.coder.inner:
                got = self[text[:cut]] + self[text[cut:]]
            else:
                got = array("H", self.coder.chunk(text)).tobytes()
            if len(text) > 64:
                return got
        if len(self) >= self.bound:
            self.old = dict(self)
            self.clear()
        self[text] = got
        return got


class PieceTable:
    """Encoder over the pieces of one BPE model."""

    def __init__(self, model: bytes, chunk_bound: int = 150_000, pair_bound: int = 400_000):
        self.library = sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.bytes, self.rank, self.id = {}, {}, {}
        for i in range(sp.vocab_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.id[piece], self.rank[piece] = i, -sp.get_score(i)
        self.eos, self.unknown = sp.eos_id(), sp.unk_id()
        if any(SPACE in p.lstrip(SPACE) or (p.startswith(SPACE * 2) and p.strip(SPACE)) for p in self.id):
            raise ValueError("pieces with inner spaces are not supported")
        self.runs = max(len(p) for p in self.id if not p.strip(SPACE))
        self.spaces = [tuple(self.id[p] for p in self.merged(SPACE * n)) for n in range(2 * self.runs)]
        self.parts: dict[str, tuple[str, str] | None] = {}
        self.pairs: dict[int, bool] = {}
        self.chunks = ChunkCache(self, chunk_bound)
        self.pair_bound = pair_bound
        if sp.vocab_size() > 1 << 16:
            raise ValueError("more than 65536 ids are not supported")
        self.names = [sp.id_to_piece(i) for i in range(sp.vocab_size())]
        self.digits = [str(i) for i in range(sp.vocab_size())]
        self.automaton = ahocorasick.Automaton()
        for piece in self.id:
            if piece.strip(SPACE) or piece == SPACE:
                if self.split(piece) is not False:
                    self.automaton.add_word(piece, (len(piece), self.id[piece]))
        self.automaton.make_automaton()
        self.inner = {p[i : i + 2] for p in self.id for i in range(len(p) - 1)}

    def merged(self, text: str) -> list[str]:
        """The definition: merge the best-ranked adjacent pair, leftmost first. For pieces only."""
        parts = list(text)
        while True:
            best = min(((self.rank.get(parts[i] + parts[i + 1], float("inf")), i) for i in range(len(parts) - 1)), default=(float("inf"), 0))
            if best[0] == float("inf"):
                return parts
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]

    def split(self, piece: str):
        """The two tokens whose merge makes the piece, None for a character, False if merging never makes it."""
        if piece not in self.parts:
            if len(piece) == 1:
                self.parts[piece] = None
            else:
                parts, last = list(piece), None
                while len(parts) > 1:
                    rank, i = min((self.rank.get(parts[i] + parts[i + 1], float("inf")), i) for i in range(len(parts) - 1))
                    if rank == float("inf"):
                        break
                    last = (parts[i], parts[i + 1])
                    parts[i : i + 2] = [parts[i] + parts[i + 1]]
                self.parts[piece] = last if len(parts) == 1 else False
        return self.parts[piece]

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging left + right leaves just these two: undo the merges of both, the later
        first, and see that no merge across the border would have come before the one undone."""
        key = left << 16 | right
        got = self.pairs.get(key)
        if got is None:
            rank, a, b, limit = self.rank, self.names[left], self.names[right], float("inf")
            while True:
                across = rank.get(a + b)
                if across is not None and across < limit:
                    got = False
                    break
                ra, rb = rank[a] if len(a) > 1 else -1, rank[b] if len(b) > 1 else -1
                if ra < 0 and rb < 0:
                    got = True
                    break
                if ra > rb:
                    limit, a = ra, self.split(a)[1]
                else:  # the border lies left of this merge, so that it would win a tie
                    limit, b = rb + 0.5, self.split(b)[0]
            if len(self.pairs) >= self.pair_bound:
                self.pairs.clear()
            self.pairs[key] = got
        return got

    def table(self, chunk: str) -> tuple[int, ...]:
        """Ids of one chunk without runs of spaces, from its prefix table."""
        n, pairs = len(chunk), self.pairs
        last, size = [-1] * n, [1] * n  # -1: a character outside the vocabulary, which merges with nothing
        done = -1
        for i, (length, piece) in self.automaton.iter(chunk):  # at each end the longest piece first
            if i == done:
                continue
            at = i - length
            if at >= 0 and (before := last[at]) >= 0:
                fits = pairs.get(before << 16 | piece)
                if fits is None:
                    fits = self.compatible(before, piece)
                if not fits:
                    continue
            last[i], size[i], done = piece, length, i
        out, i = [], n - 1
        while i >= 0:
            if last[i] < 0:
                out.extend(self.bytes.get(x, self.unknown) for x in reversed(chunk[i].encode("utf-8", "surrogatepass")))
            else:
                out.append(last[i])
            i -= size[i]
        return tuple(reversed(out))

    def chunk(self, text: str) -> tuple[int, ...]:
        """A word with the spaces before it, cut further where no piece joins the characters."""
        if len(text) <= LONG and text[1:2] != SPACE:  # at most one space, which is then part of the word
            return self.table(text)
        bare = text.lstrip(SPACE)
        spaces = len(text) - len(bare)
        out: list[int] = []
        if spaces:
            bare = SPACE + bare
        if len(bare) > 1 or not spaces:
            start = 0
            for i in range(1, len(bare)):
                if i - start >= LONG and bare[i - 1 : i + 1] not in self.inner:
                    out.extend(self.table(bare[start:i]))
                    start = i
            out.extend(self.table(bare[start:]))
            if spaces and out[0] == self.id[SPACE]:
                out.pop(0)
            else:
                spaces -= bool(spaces)
        return self.run_of(spaces) + tuple(out)

    def run_of(self, n: int) -> tuple[int, ...]:
        """Spaces merge with each other last and from the left, so full runs come first."""
        full = max(0, n // self.runs - 1)
        return (self.id[SPACE * self.runs],) * full + self.spaces[n - full * self.runs]

    def encode(self, text: str | None) -> list[int]:
        """Ids with the end id."""
        if not text:
            return [self.eos]
        parts = _PART.findall(SPACE + text.replace(" ", SPACE))
        ids = np.frombuffer(b"".join(map(self.chunks.__getitem__, parts)), np.uint16).tolist()
        ids.append(self.eos)
        return ids

    def encode_many(self, texts: list[str | None]) -> list[list[int]]:
        """encode() of each text; a word met often in the batch is looked up once."""
        plain = [i for i, t in enumerate(texts) if t and "  " not in t and SPACE not in t and t[0] != " " and t[-1] != " "]
        out: list = [None] * len(texts)
        if plain:
            words = pc.split_pattern(pa.array([texts[i] for i in plain], pa.large_string()), " ")
            known = words.flatten().dictionary_encode()
            packed = [self.chunks[SPACE + w] for w in known.dictionary.to_pylist()]
            size = np.fromiter((len(x) >> 1 for x in packed), np.int64, len(packed))
            start, at = np.cumsum(size) - size, known.indices.to_numpy()
            pool, take = np.frombuffer(b"".join(packed), np.uint16), size[at]
            before = np.cumsum(take)
            ids = pool[np.repeat(start[at] - before + take, take) + np.arange(before[-1])]
            ends = before[words.offsets.to_numpy()[1:] - 1]
            for i, part in zip(plain, np.split(ids, ends[:-1])):
                out[i] = [*part.tolist(), self.eos]
        return [self.encode(texts[i]) if x is None else x for i, x in enumerate(out)]

    def show(self, ids: list[int]) -> str:
        digits = self.digits
        return " ".join([digits[i] for i in ids])


_tables: dict[str, PieceTable] = {}


def piece_table(name: str, model: bytes) -> PieceTable:
    key = f"{name}:{hashlib.sha256(model).hexdigest()}"
    if key not in _tables:
        _tables.clear()
        _tables[key] = PieceTable(model)
    return _tables[key]


def _coding(model, with_ids: bool):
    sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()

    def run(batches):
        coder = piece_table("model", model.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, STEP):  # ids of a step only are in memory as numbers of Python
                part = batch.slice(lo, STEP)
                n, packed, id_sha, text_sha = [], [], [], []
                for ids in coder.encode_many(part.column("text").to_pylist()):
                    n.append(len(ids))
                    id_sha.append(sha(coder.show(ids)))
                    text_sha.append(sha(coder.library.decode(ids)))
                    if with_ids:
                        packed.append(np.array(ids, np.int32))
                arrays = [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(id_sha, pa.string()), pa.array(text_sha, pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    arrays.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *n]), pa.int32()), pa.array(np.concatenate(packed))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names=names)
        _tables.clear()  # what a task has remembered does not stay in the worker; a table is built in half a second

    return run


def encode_pieces(docs: DataFrame, model_path: str, with_ids: bool = True, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs -> (doc_id, n_tokens, ids_sha256, decoded_sha256, ids): one row for each input row.

    Ids are those of the sentencepiece library with an end id and no sampling; the decoded text is
    that of its decode(ids). A null or empty text is the end id alone. Very long texts are read
    whole; other columns are not looked at; an empty table gives an empty table. The model file
    (0.5 MB, on the driver) goes to the tasks as a broadcast of its bytes.
    """
    with open(model_path, "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return docs.mapInArrow(_coding(model, with_ids), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
