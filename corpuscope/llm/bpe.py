"""Byte-pair encoding with a public tokenizer: content-defined chunk reuse, and overlap resynchronisation for counts.

The tokenizer never lets a token cross ASCII white space, so the encoding of a text is the
concatenation of the encodings of its white-space-free words. ``Encoder`` checks that its file is of that kind and keeps the encodings of the
words it has seen, up to a bound in bytes, per Python worker. New words of an Arrow batch go to the library side by side,
parted by a special token.

``encode_documents`` cuts each text where a rolling hash of eight bytes says so, which falls on the same content
in every copy. Chunk bodies shared by documents are encoded once per worker. A cut may split a word:
the join is repaired by re-encoding the stretch from the last white space before to the first after
it, together with a neighbouring word on each side, and widened until that agrees with the
pieces on both sides. The joins of a batch are re-encoded in one call.

``count_tokens`` encodes a huge text in overlapping chunks with offsets. Two chunks are spliced inside a run of tokens that both have, by id and
by place, without either chunk's first and last token. Every two neighbours in the spliced sequence then stand side by side in
one chunk's encoding, and a byte-pair encoding is right if every two neighbours are. Where an overlap has no such run it is widened;
where the whole chunk has none, the chunk doubles, so that a text is encoded a bounded number of times over.

Defined cases: null counts as empty; empty texts give no tokens; repeated rows are rows of their own; a tokenizer of another kind is an error.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corpuscope.llm.text import NOT_SPACE, pieces, utf8

#: bytes of words, and of chunk bodies, that a worker remembers
MEMO_BYTES = 60_000_000
#: words encoded side by side in one text; longer words go alone
JOINED, LONG_WORD = 512, 256
#: letters of Latin-1, which no normalisation turns into anything but letters, and perhaps one mark behind them
MARKS = b".,;:!?"
PLAIN = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+[.,;:!?]?")
#: tokens in a row that two chunks must share by id and place
AGREE = 4


class Encoder:
    """Encodings of words by one tokenizer file, kept up to a bound."""

    made: dict[str, Encoder] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        made_of = json.loads(self.library.to_str())
        first = (made_of["pre_tokenizer"] or {}).get("pretokenizers", [{}])[0]
        if made_of["decoder"] is not None or made_of["model"]["type"] != "BPE" or (
                first.get("type"), first.get("behavior"), first.get("invert")) != ("Split", "Removed", True):
            raise ValueError("needs a byte-pair tokenizer that drops white space between words and has no decoder")
        marks = [t for t in made_of["added_tokens"] if t["special"] and not t["lstrip"] and not t["rstrip"]]
        self.mark, self.mark_id = (marks[-1]["content"], marks[-1]["id"]) if marks else (None, None)
        self.starts = tuple({t["content"][0].encode() for t in made_of["added_tokens"]})
        names = self.library.get_vocab(with_added_tokens=True)
        self.names = [""] * (max(names.values()) + 1)
        for name, i in names.items():
            self.names[i] = name
        suffix = made_of["model"]["end_of_word_suffix"]
        self.closes = np.array([bool(suffix) and name.endswith(suffix) for name in self.names])
        self.closed = bool(self.closes.any())
        self.chunks: dict[bytes, tuple[bytes, str]] = {}
        self.counts: dict[bytes, int] = {}
        self.joined: dict[bytes, bytes] = {}
        self.shown: dict[bytes, str] = {}
        self.held = {"chunks": 0, "counts": 0, "joined": 0}

    @classmethod
    def of(cls, path: str) -> Encoder:
        """One encoder per worker process and file."""
        if path not in cls.made:
            import os

            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            cls.made[path] = cls(path)
        return cls.made[path]

    def ids(self, texts: list[bytes]) -> list[np.ndarray]:
        found = self.library.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)
        return [np.array(e.ids, "<u4") for e in found]

    def new_words(self, words: Iterable[bytes], known: dict) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]]:
        """Words that are not known, many at a time: the words, all ids, and where each word's ids begin and end.

        Plain words go to the library side by side, for each ends with as many word ends as it has runs of letters and marks; others
        parted by a special token, and alone where a special token's first character occurs.
        """
        plain, side, alone = [], [], []
        for w in set(words).difference(known):
            if len(w) <= LONG_WORD and self.closed and PLAIN.fullmatch(w):
                plain.append(w)
            else:
                (alone if self.mark is None or len(w) > LONG_WORD or any(c in w for c in self.starts) else side).append(w)
        parts = [plain[i : i + JOINED] for i in range(0, len(plain), JOINED)]
        for part, ids in zip(parts, self.ids([b" ".join(part) for part in parts]) if parts else []):
            runs = np.cumsum([1 + (w[-1] in MARKS) for w in part])
            closed = np.flatnonzero(self.closes[ids]) + 1
            if len(closed) == runs[-1]:
                ends = closed[runs - 1]
                yield part, ids, np.append(0, ends[:-1]), ends
            else:
                alone += part
        parts = [side[i : i + JOINED] for i in range(0, len(side), JOINED)]
        for part, ids in zip(parts, self.ids([self.mark.encode().join(part) for part in parts]) if parts else []):
            cuts = np.flatnonzero(ids == self.mark_id)
            if len(cuts) + 1 == len(part):
                yield part, ids, np.append(0, cuts + 1), np.append(cuts, len(ids))
            else:
                alone += part
        for i in range(0, len(alone), JOINED):
            part = alone[i : i + JOINED]
            found = self.ids(part)
            ends = np.cumsum([len(x) for x in found])
            yield part, np.concatenate(found), np.append(0, ends[:-1]), ends

    def room(self, memo: str, *kept: dict) -> None:
        """Forget a memo that has grown past its bound."""
        if self.held[memo] > MEMO_BYTES:
            for x in kept:
                x.clear()
            self.held[memo] = 0

    def count_all(self, texts: list[list[bytes]]) -> list[int]:
        """Tokens of texts given as words."""
        self.room("counts", self.counts)
        for part, _, begin, end in self.new_words((w for words in texts for w in words), self.counts):
            self.counts.update(zip(part, (end - begin).tolist()))
            self.held["counts"] += sum(map(len, part)) + 100 * len(part)
        return [sum(map(self.counts.__getitem__, words)) for words in texts]

    def learn(self, words: Iterable[bytes]) -> None:
        for part, ids, begin, end in self.new_words(words, self.joined):
            flat, names = ids.tobytes(), [*map(self.names.__getitem__, ids.tolist())]
            places = [*zip(begin.tolist(), end.tolist())]
            self.joined.update(zip(part, [flat[4 * a : 4 * b] for a, b in places]))
            self.shown.update(zip(part, [" ".join(names[a:b]) for a, b in places]))
            self.held["joined"] += 2 * sum(map(len, part)) + 4 * len(ids) + 200 * len(part)

    def assembled(self, words: list[bytes]) -> tuple[bytes, str]:
        """Ids of learnt words as 32-bit little-endian bytes, and the decoded text."""
        return b"".join(map(self.joined.__getitem__, words)), " ".join(filter(None, map(self.shown.__getitem__, words)))


def cut_places(data: np.ndarray, offsets: np.ndarray, mean: int) -> np.ndarray:
    """Bytes before which a chunk begins: the hash of the eight bytes before is a multiple of ``mean``."""
    if len(data) <= 8:
        return offsets[:-1]
    x = data.astype(np.uint64)
    for shift in (1, 2, 4):
        x = x[:-shift] | (x[shift:] << np.uint64(8 * shift))
    x = (x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - (mean - 1).bit_length())
    return np.flatnonzero(x == 0) + 8


def segments(raw: bytes, cuts: np.ndarray, spaces: np.ndarray) -> list[tuple[int, int, bool]]:
    """Bodies and joins (True) of one text. A join runs from the last white space before a cut to the first behind it."""
    at = np.searchsorted(spaces, cuts)
    left = np.where(at > 0, spaces[np.maximum(at - 1, 0)] if len(spaces) else 0, 0)
    right = np.where(at < len(spaces), spaces[np.minimum(at, len(spaces) - 1)] if len(spaces) else 0, len(raw))
    out, done = [], 0
    for a, b in zip(left.tolist(), right.tolist()):
        if a < done:  # no white space since the cut before: the joins become one
            if out and out[-1][2] and b > done:
                out[-1] = (out[-1][0], b, True)
                done = b
                continue
            a = done
        if a > done:
            out.append((done, a, False))
        if b > a:
            out.append((a, b, True))
        done = max(done, b)
    if done < len(raw):
        out.append((done, len(raw), False))
    return out


def around(raw: bytes, a: int, b: int) -> list[bytes]:
    """The words of raw[a:b] with the whole word before and the one after, as far as they are near."""
    before, after = raw[max(0, a - 64) : a].split(), raw[b : b + 64].split()
    before = before[-1:] if a > 64 and len(before) > 1 or a <= 64 else []
    after = after[:1] if b + 64 < len(raw) and len(after) > 1 or b + 64 >= len(raw) else []
    return [*before, *raw[a:b].split(), *after]


def widened(encoder: Encoder, raw: bytes, a: int, b: int) -> None:
    """Re-encode a wider and wider stretch around a join until it agrees with the encoding of its words."""
    while a or b < len(raw):
        a, b = max(0, a - 256), min(len(raw), b + 256)
        while a and raw[a - 1 : a].strip():
            a -= 1
        while b < len(raw) and raw[b : b + 1].strip():
            b += 1
        words = around(raw, a, b)
        encoder.learn(words)
        if encoder.assembled(words)[0] == encoder.ids([b" ".join(words)])[0].tobytes():
            return
    raise ValueError("a text's encoding does not agree with the encoding of its words")


def encode_texts(encoder: Encoder, texts: list[tuple[bytes, list[tuple[int, int, bool]]]]) -> list[tuple[bytes, str]]:
    """Ids and decoded text of texts cut into segments; new chunks and joins of all of them are encoded together."""
    encoder.room("chunks", encoder.chunks)
    encoder.room("joined", encoder.joined, encoder.shown)
    new, joins, words = set(), {}, set()
    for raw, segs in texts:
        for a, b, join in segs:
            body = raw[a:b]
            if body in encoder.chunks or join and body in joins or not join and body in new:
                continue
            words.update(body.split())
            if join:
                joins[body] = raw, a, b, around(raw, a, b)
                words.update(joins[body][3])
            else:
                new.add(body)
    encoder.learn(words)
    checks = list(joins.values())
    for (raw, a, b, near), ids in zip(checks, encoder.ids([b" ".join(c[3]) for c in checks]) if checks else []):
        if encoder.assembled(near)[0] != ids.tobytes():
            widened(encoder, raw, a, b)
    for body in (*new, *joins):
        known = encoder.chunks[body] = encoder.assembled(body.split())
        encoder.held["chunks"] += len(body) + len(known[0]) + len(known[1]) + 200
    out = []
    for raw, segs in texts:
        parts = [encoder.chunks[raw[a:b]] for a, b, _ in segs]
        out.append((b"".join(p[0] for p in parts), " ".join(p[1] for p in parts if p[1])))
    return out


def encode_documents(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", mean: int = 2048,
    outputs: bool = True,
) -> DataFrame:
    """One row per document: id, n_tokens, ids_sha256, decoded_sha256 and, with ``outputs``, ids and decoded text."""
    source = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    kind = source.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(tokenizer)
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for i, j in pieces(offsets):
                part, own = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                cuts, spaces = cut_places(part, own, mean), np.flatnonzero(~NOT_SPACE[part])
                texts = []
                for k in range(j - i):
                    a, b = own[k], own[k + 1]
                    c = cuts[np.searchsorted(cuts, a + 8) : np.searchsorted(cuts, b)] - a
                    s = spaces[np.searchsorted(spaces, a) : np.searchsorted(spaces, b)] - a
                    raw = part[a:b].tobytes()
                    texts.append((raw, segments(raw, c, s)))
                rows = [(ids, shown, hashlib.sha256(ids).hexdigest(), hashlib.sha256(shown.encode()).hexdigest())
                        for ids, shown in encode_texts(encoder, texts)]
                out = [batch.column(0).slice(i, j - i), pa.array([len(r[0]) // 4 for r in rows], pa.int64()),
                       pa.array([r[2] for r in rows]), pa.array([r[3] for r in rows])]
                names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if outputs:
                    out += [pa.array([np.frombuffer(r[0], "<u4").astype(np.int32) for r in rows], pa.list_(pa.int32())),
                            pa.array([r[1] for r in rows])]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(out, names)

    schema = f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return source.mapInArrow(run, schema + (", ids array<int>, decoded string" if outputs else "")).withColumnRenamed(
        "id", id_col
    )


class Placed:
    """The encoding of text[begin:end]: ids and the characters where its tokens begin and end."""

    def __init__(self, encoder: Encoder, text: str, begin: int, end: int):
        found = encoder.library.encode(text[begin:end], add_special_tokens=False)
        places = np.array(found.offsets, np.int64).reshape(-1, 2) + begin
        self.begin, self.end = begin, end
        self.ids, self.starts, self.ends = np.array(found.ids, np.int64), places[:, 0], places[:, 1]

    def splice(self, later: Placed, agree: int = AGREE) -> tuple[int, int] | None:
        """Tokens of this chunk, and tokens of the later one, before a boundary that both have; None if they share no run."""
        width = max(self.end, later.end) + 1
        mine, theirs = ((c.starts * width + c.ends) for c in (self, later))
        # several tokens of one character have one place; their order tells them apart
        first = np.searchsorted(self.starts, later.begin)
        at = np.arange(first, max(first, len(self.ids) - 1))
        to = np.searchsorted(theirs, mine[at])
        ok = (to > 0) & (to < len(theirs) - 1)
        at, to = at[ok], to[ok]
        ok = (theirs[to] == mine[at]) & (later.ids[to] == self.ids[at]) & (self.starts[at] < self.ends[at])
        # a token whose place another one shares is no sure match
        alone = np.ones(len(theirs), bool)
        alone[1:] &= theirs[1:] != theirs[:-1]
        alone[:-1] &= theirs[1:] != theirs[:-1]
        ok &= alone[to]
        at, to = at[ok], to[ok]
        if len(at) < agree:
            return None
        run = (at[agree - 1 :] - at[: len(at) - agree + 1] == agree - 1) & (to[agree - 1 :] - to[: len(to) - agree + 1] == agree - 1)
        runs = np.flatnonzero(run)
        if not len(runs):
            return None
        middle = int(runs[len(runs) // 2]) + agree // 2
        return int(at[middle]), int(to[middle])


def count_long(encoder: Encoder, text: str, size: int, overlap: int) -> int:
    """Tokens of a long text from overlapping chunks."""
    total, skip = 0, 0  # tokens counted so far; tokens of the chunk that are counted already
    chunk = Placed(encoder, text, 0, min(size, len(text)))
    reach = size
    while chunk.end < len(text):
        width, met = overlap, None
        while met is None:
            begin = max(chunk.begin, chunk.end - width)
            later = Placed(encoder, text, begin, min(len(text), chunk.end + reach))
            met = chunk.splice(later)
            if met is not None and met[0] < skip:
                met = None
            if begin == chunk.begin:
                break
            # an odd step, so that texts that repeat do not meet at the same phase again
            width = 4 * width + 1
        if met is None:  # from the chunk's own beginning on, all that follows is encoded anew
            chunk, reach = later, 2 * reach
            continue
        total += met[0] - skip
        chunk, skip, reach = later, met[1], size
    return total + len(chunk.ids) - skip


def count_tokens(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048,
    chunk: int = 32_768, overlap: int = 512,
) -> DataFrame:
    """One row per document: id, n_bytes, n_tokens, over_limit. Texts of more than ``chunk`` bytes go in chunks of so many characters."""
    source = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    kind = source.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(tokenizer)
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for i, j in pieces(offsets):
                raw = [data[a:b].tobytes() for a, b in zip(offsets[i:j].tolist(), offsets[i + 1 : j + 1].tolist())]
                sizes = np.array([len(r) for r in raw], np.int64)
                short = [r.split() if len(r) <= chunk else [] for r in raw]
                counts = encoder.count_all(short)
                for k in np.flatnonzero(sizes > chunk).tolist():
                    counts[k] = count_long(encoder, raw[k].decode(), chunk, overlap)
                tokens = np.array(counts, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(sizes), pa.array(tokens), pa.array(tokens > limit)],
                    ["id", "n_bytes", "n_tokens", "over_limit"],
                )

    return source.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)
