"""BPE as a streaming transducer, and decoding as an incremental state machine.

The encoder reads symbols from the left and keeps a small buffer. From the merge list it computes the
*sufficient lookahead*: how many symbols to the right of a token's end can still change that token. A token
that ends at least that far before the end of the buffer is final and is emitted, so memory stays constant
however long the text or a word is. Emitted boundaries are final, hence the rest can be encoded on its own.

Texts are cut at white space first, since no token crosses it; results of frequent pieces are remembered in a
cache of bounded size, which is cleared when full.

Null and empty texts have no tokens. Repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import unicodedata
from functools import lru_cache

from pyspark.sql import DataFrame

from wattloom.llm.common import columns_of, large_cache, map_batches, tokenizer_path

CACHE_ENTRIES = 250_000
ROUND_TRIPS = 160_000             # finished stretches that a worker keeps, in each of two generations: some 120 MB
SCHEMA = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"

#: Unicode white space; str.split() knows four more characters, which are not white space here.
WHITE = "\t\n\v\f\r \x85\xa0  -     　"
_WHITE_RUN, _ODD_BREAKS = re.compile(f"[{WHITE}]+"), re.compile("[\x1c-\x1f]")


def byte_symbols() -> list[str]:
    """Visible character of each byte: itself where printable in Latin-1, else the next from U+0100 on."""
    keep = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, spare = [], 256
    for b in range(256):
        out.append(chr(b if b in keep else spare))
        spare += b not in keep
    return out


def split_white(text: str) -> list[str]:
    if _ODD_BREAKS.search(text):
        return [p for p in _WHITE_RUN.split(text) if p]
    return text.split()


_STOP = re.compile(r"[.,](?<=[a-z].)(?=[ \n]|\Z)")         # starts with a class, which the engine searches fast


def chunks(text: str | None, lower: bool = True) -> list[str]:
    """Stretches of a text without white space, brought to fewer forms."""
    return split_white(spaced(text, lower))


def spaced(text: str | None, lower: bool = True) -> str:
    """A text brought to fewer forms of its stretches where that changes no token: lower case
    (the tokenizer lower-cases normalized text anyway), and a full stop or comma after a letter on its own."""
    if not text:
        return ""
    if lower and "<|" not in text and (text.isascii() or (
            "Σ" not in text and "İ" not in text and unicodedata.is_normalized("NFC", text))):
        text = text.lower()
    return _STOP.sub(r" \g<0>", text)


class Transducer:
    """Encoder and decoder of one tokenizer file (byte-level BPE, with or without word ends)."""

    def __init__(self, path: str):
        import regex
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.ranks = {p: r for r, p in enumerate(pairs)}
        self.lookahead = sufficient_lookahead(pairs, self.suffix)
        self.symbols = byte_symbols()
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.names = {i: t for t, i in (self.vocab | self.special).items()}
        self.pieces = regex.compile(_piece_pattern(spec["pre_tokenizer"]))
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") \
            if self.special else None
        self.lower = "Lowercase" in json.dumps(spec.get("normalizer"))
        self.known = Cache(lambda piece: list(self.stream(piece.encode("utf-8", "replace"))), CACHE_ENTRIES // 4)
        self.unescape = {c: b for b, c in enumerate(self.symbols)}

    # encoding -------------------------------------------------------------------------------------
    def normal(self, text: str) -> str:
        text = unicodedata.normalize("NFC", text)
        # one capital has a context rule in Python's lower(), which the library's does not have
        return text.replace("Σ", "σ").lower() if self.lower else text

    def encode_chunk(self, chunk: str) -> list[int]:
        """Ids of a text without white space."""
        if self.lower and chunk.isascii() and chunk.isalpha():
            return self.known[chunk.lower()]
        ids: list[int] = []
        for part in self.cut.split(chunk) if self.cut else [chunk]:
            if part in self.special:
                ids.append(self.special[part])
            elif part:
                for piece in self.pieces.findall(self.normal(part)):
                    ids += self.known[piece]
        return ids

    def encode(self, text: str | None) -> list[int]:
        return [i for c in split_white(text or "") for i in self.encode_chunk(c)]

    def stream(self, word: bytes, room: int = 0):
        """Ids of one word, emitted as soon as they are stable. The buffer holds ``room`` symbols at most."""
        room = room or 4 * self.lookahead + 64
        at, n, names = 0, len(word), self.symbols
        if n <= room:
            parts = [names[b] for b in word]
            parts[-1] += self.suffix
            yield from map(self.vocab.__getitem__, self.merged(parts))
            return
        buffer: list[str] = []
        while at < n or buffer:
            take = word[at:at + room - len(buffer)]
            at += len(take)
            buffer += [names[b] for b in take]
            if at == n:
                buffer[-1] += self.suffix
                yield from (self.vocab[t] for t in self.merged(buffer))
                return
            tokens, end, done = self.merged(list(buffer)), 0, 0
            for t in tokens:
                if end + len(t) > len(buffer) - self.lookahead:
                    break
                end, done = end + len(t), done + 1
            yield from (self.vocab[t] for t in tokens[:done])
            buffer = buffer[end:]

    def merged(self, parts: list[str]) -> list[str]:
        """Apply the merge list: each time the pair of lowest rank, the leftmost first."""
        get, none = self.ranks.get, len(self.ranks)
        ranks = [get(p, none) for p in zip(parts, parts[1:])]
        while ranks:
            low = min(ranks)
            if low == none:
                break
            i = ranks.index(low)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = get((parts[i - 1], parts[i]), none)
            if i < len(ranks):
                ranks[i] = get((parts[i], parts[i + 1]), none)
        return parts

    # decoding -------------------------------------------------------------------------------------
    def decode(self, ids) -> str:
        """As the library decodes with this file: it names no decoder, so tokens stand apart by a space."""
        return " ".join(self.names[i] for i in ids if i in self.names)

    def text(self, ids) -> str:
        """Plain text of the ids."""
        machine = ByteMachine(self)
        return "".join(map(machine.feed, ids)) + machine.close()


class ByteMachine:
    """Ids in, text out. Holds at most the bytes of one unfinished character."""

    def __init__(self, of: Transducer):
        self.of, self.utf8 = of, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, token: int) -> str:
        name = self.of.names.get(token, "")
        if name in self.of.special:
            return self.utf8.decode(b"", True) + name + " "
        end = bool(self.of.suffix) and name.endswith(self.of.suffix)
        raw = bytes(self.of.unescape[c] for c in (name[:-len(self.of.suffix)] if end else name))
        return self.utf8.decode(raw, end) + (" " if end else "")

    def close(self) -> str:
        return self.utf8.decode(b"", True)


def sufficient_lookahead(pairs: list[tuple[str, str]], suffix: str = "") -> int:
    """Largest number of symbols right of a boundary that can decide whether a merge takes place over it.

    A merge (u, v) fails to its right only if a piece s at the right edge of v is taken earlier by a merge
    (s, x) of lower rank, and that in turn may depend on what follows x. So its reach is the length of v plus
    the largest reach of such a merge, and one pass over the list in order of rank finds all reaches.
    """
    def size(token: str) -> int:
        return len(token.removesuffix(suffix)) if suffix and token != suffix else len(token)

    right: dict[str, str] = {}
    reach: dict[str, int] = {}
    most = 1
    for u, v in pairs:
        edge, s = 0, v
        while s is not None:
            edge = max(edge, reach.get(s, 0))
            s = right.get(s)
        mine = size(v) + edge
        most = max(most, mine)
        reach[u] = max(reach.get(u, 0), mine)
        right.setdefault(u + v, v)
    return most


def _piece_pattern(spec: dict) -> str:
    for step in spec.get("pretokenizers", [spec]):
        if step["type"] == "Split":
            return step["pattern"]["Regex"]
    raise ValueError("the tokenizer file has no split pattern")


@large_cache
@lru_cache(maxsize=2)
def load(path: str) -> Transducer:
    return Transducer(path)


class Cache(dict):
    """text -> result of ``make``. Holds two generations of ``limit`` short texts; the older one goes when
    the younger is full, so frequent texts stay."""

    def __init__(self, make, limit: int = CACHE_ENTRIES):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key: str):
        out = self.old.get(key)
        if out is None:
            out = self.make(key)
        if len(key) <= 64:
            self.put(key, out)
        return out

    def put(self, key: str, value) -> None:
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value


@large_cache
@lru_cache(maxsize=2)
def round_trips(path: str) -> Cache:
    """chunk -> (number of ids, the ids as text, their decoding); kept while the Python worker lives."""
    bpe = load(path)

    def make(chunk):
        ids = bpe.encode_chunk(chunk)
        return len(ids), " ".join(map(str, ids)), bpe.decode(ids)
    return Cache(make, ROUND_TRIPS)


def bpe_round_trip(documents: DataFrame, file: str = "word_bpe_49k.json") -> DataFrame:
    """Per document: number of ids, digest of the ids, digest of their decoding.

    ``documents`` has doc_id and text. Needs no shuffle.
    """
    def rows(cols):
        get, lower = round_trips(tokenizer_path(file)).__getitem__, load(tokenizer_path(file)).lower
        n, ids, back = [], [], []
        for text in cols["text"]:
            done = [x for x in map(get, chunks(text, lower)) if x[0]]
            n.append(sum(x[0] for x in done))
            ids.append(hashlib.sha256(" ".join([x[1] for x in done]).encode()).hexdigest())
            back.append(hashlib.sha256(" ".join([x[2] for x in done]).encode()).hexdigest())
        return {"doc_id": cols["doc_id"], "n_tokens": n, "ids_sha256": ids, "decoded_sha256": back}

    return map_batches(columns_of(documents, "doc_id", "text"), SCHEMA, rows)


def encode_ids(documents: DataFrame, file: str = "word_bpe_49k.json") -> DataFrame:
    """doc_id and the ids themselves."""
    def rows(cols):
        bpe = load(tokenizer_path(file))
        return {"doc_id": cols["doc_id"], "ids": [bpe.encode(t) for t in cols["text"]]}
    return map_batches(columns_of(documents, "doc_id", "text"), "doc_id bigint, ids array<int>", rows)


def decode_ids(encoded: DataFrame, file: str = "word_bpe_49k.json") -> DataFrame:
    """doc_id and the text of the ids (null where the ids are missing)."""
    def rows(cols):
        bpe = load(tokenizer_path(file))
        return {"doc_id": cols["doc_id"], "text": [None if i is None else bpe.text(i) for i in cols["ids"]]}
    return map_batches(columns_of(encoded, "doc_id", "ids"), "doc_id bigint, text string", rows)
