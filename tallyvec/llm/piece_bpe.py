"""SentencePiece merge-type (BPE) encoding and decoding, exact, by backtracking.

A greedy pass takes the longest vocabulary match at each position (Aho-Corasick).  A token may
follow another only if merging the two tokens' joined text from scratch gives back these two
tokens; otherwise the next shorter match is tried, and a bitfield remembers the positions from
which no valid continuation exists.  A sequence whose neighbours are all compatible is the one
that merging yields, so the result equals the library's.

No piece has a space mark after another character, none has a line end, and bytes-fallback
characters never merge, so a text falls apart into runs (space marks and the word after them) that
are encoded on their own and remembered in two generations of bounded size.  The model is refused
where one of these doesn't hold.

Null texts count as empty: no ids, empty decoded text; texts without words are encoded like any
other.  Each row is handled on its own: rows that repeat give equal rows, null ids stay null, an
empty table gives an empty result.  A very long text costs memory in proportion to its length.
Extra columns are left alone (encode, decode) or not looked at (round_trip_digest).
"""

from __future__ import annotations

import codecs
import hashlib
import re
import struct
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

SPACE = "▁"
EMPTY = hashlib.sha256(b"").hexdigest()
#: Runs in each of two generations that one Python worker remembers; runs longer than LONG are not remembered.
CACHE_RUNS, LONG = 100_000, 48
#: A sign for each byte that belongs to no character.
codecs.register_error("tallyvec-bytes", lambda e: ("\ufffd" * (e.end - e.start), e.end))


def _fields(b: bytes):
    """(field number, value) of a protocol-buffer message; varints, fixed and length-delimited."""
    i, n = 0, len(b)

    def varint():
        nonlocal i
        value = shift = 0
        while True:
            c = b[i]
            i += 1
            value |= (c & 127) << shift
            shift += 7
            if c < 128:
                return value

    while i < n:
        key = varint()
        number, wire = key >> 3, key & 7
        if wire == 0:
            yield number, varint()
        else:
            size = varint() if wire == 2 else 4 if wire == 5 else 8
            yield number, b[i : i + size]
            i += size


class PieceModel:
    """Vocabulary, scores and the encoder of one model file."""

    def __init__(self, path: str):
        self.pieces: list[str] = []
        scores: list[float] = []
        kinds: list[int] = []
        dummy, squeeze, charsmap = 1, 1, b""
        with open(path, "rb") as f:
            data = f.read()
        for number, value in _fields(data):
            if number == 1:
                d = dict(_fields(value))
                self.pieces.append(d[1].decode())
                scores.append(struct.unpack("<f", d.get(2, b"\0\0\0\0"))[0])
                kinds.append(d.get(3, 1))
            elif number == 2 and dict(_fields(value)).get(3, 1) != 2:
                raise ValueError("not a merge-type model")
            elif number == 3:
                d = dict(_fields(value))
                dummy, squeeze, charsmap = d.get(3, 1), d.get(4, 1), d.get(2, b"")
        if squeeze or charsmap or {4, 5} & set(kinds):
            raise ValueError("the model needs a normaliser or piece kinds that this encoder lacks")
        self.dummy = bool(dummy)
        self.score = {p: (s, i) for i, (p, s, k) in enumerate(zip(self.pieces, scores, kinds, strict=True)) if k == 1}
        self.unk = kinds.index(2)
        self.control = {i for i, k in enumerate(kinds) if k == 3}
        self.byte_ids = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, kinds, strict=True)) if k == 6}
        self.id_bytes = {i: b for b, i in self.byte_ids.items()}
        if any(SPACE in p.lstrip(SPACE) for p in self.score):
            raise ValueError("a piece has a space mark inside")
        alphabet = {c for p in self.score for c in p}
        other = "".join(map(re.escape, sorted(alphabet - {SPACE})))
        self.run = re.compile(f"{SPACE}*[{other}]+|{SPACE}+|[^{other}{SPACE}]")
        if "\n" in alphabet or not all(c in self.score for c in alphabet):
            raise ValueError("a line end inside a piece, or a character of a piece that is none itself")
        self.known = alphabet
        self.valid = {p: i for p, (_, i) in self.score.items() if len(p) == 1 or self._merged(p) == [p]}
        self.auto = ahocorasick.Automaton()
        for p in self.valid:
            self.auto.add_word(p, p)
        self.auto.make_automaton()
        self.shorter = {p: next((p[:n] for n in range(len(p) - 1, 0, -1) if p[:n] in self.valid), None) for p in self.valid}
        self.written = {p: str(i) for p, i in self.valid.items()}
        self.after: dict = {}
        self.word, self.bare = _Runs(self, SPACE), _Runs(self, "")

    def _merged(self, text: str) -> list[str]:
        """Merging from single characters: the best-scored neighbours first, the leftmost of equals."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s[0] > best):
                    best, at = s[0], k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _compatible(self, a: str, b: str) -> bool:
        return self._merged(a + b) == [a, b]

    def _after(self, a: str, b: str | None) -> str | None:
        """The longest of b and the shorter pieces that it begins with that may follow a."""
        found = self.after.get((a, b), self)
        if found is self:
            found = b
            while found is not None and not self._compatible(a, found):
                found = self.shorter[found]
            if len(self.after) > 400_000:
                self.after.clear()
            self.after[a, b] = found
        return found

    def _tokens(self, text: str) -> list[str]:
        """Tokens of a run of known characters: the longest matches, from the first that doesn't fit on by backtracking."""
        tokens = [p for _, p in self.auto.iter_long(text)]
        known, a = self.after, tokens[0]
        for k in range(1, len(tokens)):
            b = tokens[k]
            found = known.get((a, b), self)
            if found is self:
                found = self._after(a, b)
            if found is not b:
                return self._backtrack(text, tokens[:k], found)
            a = b
        return tokens

    def _backtrack(self, text: str, tokens: list[str], token: str | None) -> list[str]:
        """tokens, which fit each other, made a whole encoding; token is the next candidate that fits after them."""
        n, pos, known = len(text), sum(map(len, tokens)), self.after
        failed = bytearray(n // 8 + 1)
        greedy = None  # longest matches after the last candidate
        while True:
            if token is not None:
                end = pos + len(token)
                if failed[end >> 3] >> (end & 7) & 1:
                    token, greedy = self.shorter[token], None
                    if tokens:
                        token = self._after(tokens[-1], token)
                    continue
                tokens.append(token)
                pos = end
                if pos == n:
                    return tokens
                greedy = greedy or self.auto.iter_long(text, pos)
                longest = next(greedy)[1]
                found = known.get((token, longest), self)
                token = self._after(token, longest) if found is self else found
                if token is not longest:
                    greedy = None
            else:
                if not tokens:
                    raise ValueError(f"no encoding of {text[:80]!r}")
                failed[pos >> 3] |= 1 << (pos & 7)
                last = tokens.pop()
                pos -= len(last)
                token, greedy = self.shorter[last], None
                if tokens:
                    token = self._after(tokens[-1], token)

    def run_parts(self, run: str) -> tuple[list[str], str]:
        """(ids as text, what they decode to) of a run."""
        if run[0] in self.known:
            tokens = self._tokens(run)
            return list(map(self.written.__getitem__, tokens)), "".join(tokens).replace(SPACE, " ")
        ids = [self.byte_ids.get(b, self.unk) for b in run.encode()] if len(self.byte_ids) == 256 else [self.unk]
        return list(map(str, ids)), self.piece_text(ids).decode("utf-8", "tallyvec-bytes")

    def runs(self, marked: str) -> list[str]:
        return self.run.findall(marked)

    def encode_parts(self, text: str) -> list[tuple[str, str]]:
        """(ids joined by commas, their text with space marks as spaces) by run."""
        if not text:
            return []
        out: list = []
        word, bare = self.word, self.bare
        if SPACE in text:
            text = text.replace(SPACE, " ")
        head = self.dummy
        for k, line in enumerate(text.split("\n")):
            if k:
                out.append(bare["\n"])
                head = False
            parts = line.split(" ")
            if "" in parts[0 if head else 1 :]:
                marked = (SPACE if head else "") + line.replace(" ", SPACE)
                out += map(bare.__getitem__, self.runs(marked))
            else:
                if not head:
                    if parts[0]:
                        out.append(bare[parts[0]])
                    del parts[0]
                out += map(word.__getitem__, parts)
        return out

    def encode(self, text: str) -> list[int]:
        return [int(i) for p in self.encode_parts(text) for i in p[0].split(",")]

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids joined by commas, and of the text that they decode to."""
        parts = self.encode_parts(text)
        if not parts:
            return 0, EMPTY, EMPTY
        ids, decoded = ",".join([p[0] for p in parts]), "".join([p[1] for p in parts])
        if self.dummy and decoded[:1] == " " and self.pieces[int(parts[0][0].split(",", 1)[0])].startswith(SPACE):
            decoded = decoded[1:]
        return ids.count(",") + 1, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()

    def piece_text(self, ids) -> bytes:
        out = []
        for i in ids:
            b = self.id_bytes.get(i)
            if b is not None:
                out.append(bytes([b]))
            elif i == self.unk:
                out.append(b" \xe2\x81\x87 ")
            elif i not in self.control:
                out.append(self.pieces[i].replace(SPACE, " ").encode())
        return b"".join(out)

    def decode(self, ids) -> str:
        """The text of ids; the space that the encoder put first goes, broken byte runs become U+FFFD."""
        text = self.piece_text(ids).decode("utf-8", "tallyvec-bytes")
        first = next((i for i in ids if i not in self.control), None)
        strip = self.dummy and first is not None and self.pieces[first].startswith(SPACE)
        return text[1:] if strip else text


class _Runs(dict):
    """Encoded runs by their text, with or without a space mark before it.

    A full generation becomes the old one, whose runs come back when they are met again: words that
    go on being met are never encoded twice, rare ones are forgotten.
    """

    def __init__(self, model: PieceModel, before: str):
        super().__init__()
        self.model, self.before, self.old = model, before, {}

    def __missing__(self, run: str):
        value = self.old.get(run)
        if value is None:
            model = self.model
            ids, texts = zip(*map(model.run_parts, model.runs(self.before + run)), strict=True)
            value = ",".join([i for part in ids for i in part]), "".join(texts)
        if len(run) <= LONG:
            if len(self) >= CACHE_RUNS:
                self.old = dict(self)
                self.clear()
            self[run] = value
        return value


@lru_cache(maxsize=2)
def load(path: str) -> PieceModel:
    return PieceModel(path)


def _add(df: DataFrame, column: str, name: str, kind: str, step) -> DataFrame:
    """df with one more column that step makes of each value of a column; it replaces one of that name."""
    kept = [c for c in df.columns if c != name]
    source = df.select(*[df[c] for c in kept], df[column].alias("__in"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema[:-1]) + f", `{name}` {kind}"

    def run(batches):
        for b in batches:
            made = step(b.column(b.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], made], names=[*kept, name])

    return source.mapInArrow(run, schema)


def encode(df: DataFrame, model_path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """df with a column of token ids."""
    return _add(df, text, ids, "array<int>", lambda texts: pa.array([load(model_path).encode(t or "") for t in texts], pa.list_(pa.int32())))


def decode(df: DataFrame, model_path: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """df with the text of a column of token ids; a null list gives an empty text."""
    return _add(df, ids, text, "string", lambda rows: pa.array([load(model_path).decode(r or []) for r in rows], pa.string()))


def round_trip_digest(df: DataFrame, model_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: number of ids, SHA-256 of the ids and of the text decoded from them."""

    def run(batches):
        model = load(model_path)
        for b in batches:
            rows = [model.digest(t or "") for t in b.column(1).to_pylist()]
            counts, ids_sha, text_sha = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = df.schema[doc_id].dataType.simpleString()
    return df.select(df[doc_id], df[text]).mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
