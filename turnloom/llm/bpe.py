"""BPE encoding and decoding with bounded lookahead.

``lookahead`` of the merge list bounds how many symbols after a token can still change
it, so ``transducer.Machine`` emits each token as soon as all continuations agree on it
and holds no more than that many symbols. Decoding is a byte-to-text machine that keeps
at most the three bytes of an unfinished character.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import unicodedata
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame

from turnloom.llm.texts import kept, map_texts
from turnloom.llm.transducer import Machine, Memo, lookahead

#: Words whose tokens a worker keeps.
WORDS = 120_000
#: Words whose ids are held at a time.
PART = 8192
END = "</w>"
# Fixed value: white space of the tokenizer's patterns (Unicode's White_Space).
BLANK = r"\t-\r\x20\x85\xa0  -     　"


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself where printable, else one from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in own else next(spare)) for b in range(256)]


class Bpe:
    """Both directions for a ``tokenizers`` file with word ends and lower case."""

    def __init__(self, data: bytes) -> None:
        spec = json.loads(data)
        model = spec["model"]
        kinds = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        splits = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        if (
            model["type"] != "BPE"
            or model["end_of_word_suffix"] != END
            or kinds != ["NFC", "Replace", "Lowercase"]
            or [s["type"] for s in splits] != ["Split", "ByteLevel"]
            or spec.get("decoder") is not None
        ):
            raise ValueError("not a lower-case BPE tokenizer with word ends")
        vocab: dict[str, int] = model["vocab"]
        self.letters = byte_letters()
        self.ends = {letter: letter + END for letter in self.letters}
        self.names = {number: name for name, number in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names |= {number: name for name, number in self.special.items()}
        spelling = {}
        for name, number in vocab.items():
            stem = name.removesuffix(END)
            symbols = list(stem)
            if name != stem and stem:
                symbols[-1] = self.ends.setdefault(symbols[-1], symbols[-1] + END)
            spelling[number] = symbols
        self.merges = {
            (vocab[a], vocab[b]): (k, vocab[a + b]) for k, (a, b) in enumerate(model["merges"])
        }
        self.machine = Machine(spelling, lambda a, b: self.merges.get((a, b)), lambda s: ())
        self.lookahead = lookahead(spelling, ((k, a, b) for (a, b), (k, _) in self.merges.items()))
        self.code = "H" if max(self.names, default=0) < 1 << 16 else "I"
        self.ids = Memo(self.word, WORDS)
        self.split = regex.compile(splits[0]["pattern"]["Regex"].replace(r"\s", BLANK))
        self.blanks = regex.compile(f"[{BLANK}]+")
        self.marks = regex.compile("|".join(map(regex.escape, self.special)) or "(?!)")

    def symbols(self, word: str) -> list[str]:
        plain = word.isascii() and word.isprintable()  # such bytes are their own letters
        out = list(word) if plain else [self.letters[b] for b in word.encode()]
        out[-1] = self.ends[out[-1]]
        return out

    def word(self, word: str) -> bytes:
        """The ids as bytes: a third less to keep than a tuple."""
        return array(self.code, self.machine.run(self.symbols(word))).tobytes()

    def numbers(self, words: list[str]) -> list[int]:
        return array(self.code, b"".join(map(self.ids.__getitem__, words))).tolist()

    def normal(self, text: str) -> str:
        """NFC, runs of white space as one space, each character in lower case by itself."""
        text = unicodedata.normalize("NFC", text)
        return self.blanks.sub(" ", text).replace("Σ", "σ").lower()

    def words(self, text: str) -> list[str]:
        """The words of ``normal``. None holds white space, so its runs need not become one space."""
        return self.split.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())

    def encode(self, text: str | None) -> list[int]:
        """Token ids; strings of special tokens in the text become these tokens."""
        if not text:
            return []
        ids: list[int] = []
        at = 0
        for mark in self.marks.finditer(text) if "<|" in text else ():
            ids += self._plain(text[at : mark.start()])
            ids.append(self.special[mark[0]])
            at = mark.end()
        return ids + self._plain(text[at:] if at else text)

    def _plain(self, text: str) -> list[int]:
        return self.numbers(self.words(text))

    def encoded(self, text: str | None) -> Iterator[list[int]]:
        """The ids of ``encode`` in parts of a bounded number of words."""
        at = 0
        for mark in self.marks.finditer(text) if text and "<|" in text else ():
            yield from self._parts(text[at : mark.start()])
            yield [self.special[mark[0]]]
            at = mark.end()
        if text:
            yield from self._parts(text[at:] if at else text)

    def _parts(self, text: str) -> Iterator[list[int]]:
        words = self.words(text)
        for at in range(0, len(words), PART):
            yield self.numbers(words[at : at + PART])

    def decode(self, ids: Iterable[int]) -> str:
        """As the tokenizer without a decoder gives it: token strings joined by one space."""
        names = self.names
        return " ".join([names[t] for t in ids if t in names])

    def text(self, ids: Iterable[int]) -> Iterator[str]:
        """The readable text piece by piece: bytes of the tokens, a space at each word's end."""
        back = {letter: b for b, letter in enumerate(self.letters)}
        machine = codecs.getincrementaldecoder("utf-8")(errors="replace")
        for token in ids:
            name = self.names.get(token, "")
            if name in self.special:
                yield machine.decode(b"", final=True) + name
                continue
            stem = name.removesuffix(END)
            yield machine.decode(bytes(back[c] for c in stem)) + " " * (stem != name)
        yield machine.decode(b"", final=True)


class Digests:
    """The decoder as a machine that takes tokens part by part: it keeps how many there were, whether a
    space is due, and the states of two hashes; neither ids nor text are held. Without ``digits``
    only the text is hashed."""

    def __init__(self, machine: Bpe, digits: dict[int, str] | None = None) -> None:
        self.machine, self.digits = machine, digits
        self.count = 0
        self.started = False  # whether a token that has a string has come
        self.ids, self.text = hashlib.sha256(), hashlib.sha256()

    def push(self, part: list[int]) -> None:
        if not part:
            return
        digits, names = self.digits, self.machine.names
        if digits:
            self.ids.update(((" " if self.count else "") + " ".join([digits[t] for t in part])).encode())
        self.count += len(part)
        known = [names[t] for t in part if t in names]
        if known:
            self.text.update(((" " if self.started else "") + " ".join(known)).encode())
            self.started = True


def bpe(data: bytes) -> Bpe:
    return kept((Bpe, data), lambda: Bpe(data))


def _worker(shared: Broadcast) -> Bpe:
    return bpe(shared.value)


def _shared(df: DataFrame, tokenizer: str) -> Broadcast:
    with open(tokenizer, "rb") as file:
        return df.sparkSession.sparkContext.broadcast(file.read())


def encode(df: DataFrame, tokenizer: str, keys: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keys`` and ``ids`` (array<int>), the token ids of the whole text.

    Ids are those of ``tokenizers`` without special tokens added. NULL and empty texts, and
    texts of white space only, have no ids. Repeated rows are encoded each; an empty table
    gives none; columns other than ``keys`` and the text are not read. No shuffle.
    """
    shared = _shared(df, tokenizer)

    def make():
        one = _worker(shared).encode
        return lambda texts: [[one(t) for t in texts]]

    return map_texts(df, keys, text, make, "ids array<int>", keeps=True)


def decode(df: DataFrame, tokenizer: str, keys: tuple[str, ...] = ("doc_id",), ids: str = "ids", readable: bool = False) -> DataFrame:
    """``keys`` and ``decoded``: token strings joined by spaces, or the readable text.

    NULL ids decode to the empty text; ids outside the vocabulary are left out.
    """
    shared = _shared(df, tokenizer)

    def make():
        machine = _worker(shared)
        one = (lambda x: "".join(machine.text(x))) if readable else machine.decode
        return lambda rows: [[one(x or ()) for x in rows]]

    return map_texts(df, keys, ids, make, "decoded string", keeps=True)


def round_trip(df: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_tokens, ids_sha256, decoded_sha256``: encode, decode, and digests of both.

    Both directions run in one pass, part by part, so neither ids nor decoded texts leave the
    task or are ever held whole.
    """
    shared = _shared(df, tokenizer)

    def make():
        machine = _worker(shared)
        digits = {t: str(t) for t in machine.names}

        def work(texts: list[str | None]) -> list:
            found = []
            for t in texts:
                digests = Digests(machine, digits)
                for part in machine.encoded(t):
                    digests.push(part)
                found.append((digests.count, digests.ids.hexdigest(), digests.text.hexdigest()))
            return list(map(list, zip(*found)))

        return work

    return map_texts(df, [key], text, make, "n_tokens long, ids_sha256 string, decoded_sha256 string", keeps=True)


def encode_decode(df: DataFrame, tokenizer: str, keys: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keys``, ``ids`` (array<int>), and ``decoded_sha256`` of the text that the ids decode to.

    NULL and empty texts, and texts of white space only, have no ids and decode to the empty text.
    """
    shared = _shared(df, tokenizer)

    def make():
        machine = _worker(shared)

        def work(texts: list[str | None]) -> list:
            ids, shas = [], []
            for t in texts:
                own, digests = [], Digests(machine)
                for part in machine.encoded(t):
                    digests.push(part)
                    own += part
                ids.append(np.array(own, np.int32))
                shas.append(digests.text.hexdigest())
            return [ids, shas]

        return work

    return map_texts(df, keys, text, make, "ids array<int>, decoded_sha256 string", keeps=True)
