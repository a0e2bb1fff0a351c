"""Secret scans: keywords by Aho-Corasick, anchored patterns only at hits, then checksums.

One pass of an automaton finds all keywords, whatever their number. A pattern is tried
only where its keyword stands, from there and not before the end of its last match, which
gives the same matches as a leftmost search of the whole text. Tokens that carry a
checksum count only if it holds. Runs of hexadecimal digits have no keyword; a byte
search for a long enough run stands in for it.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from typing import NamedTuple

import ahocorasick
from pyspark.sql import DataFrame

from turnloom.llm.texts import map_texts

# Kinds in order, patterns, keywords, and least lengths.
KINDS = ("assign", "access", "hex", "checked")
ASSIGN = re.compile(
    r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
CHECKED = re.compile(r"(?:gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
CHECKED_WORDS = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
REDACTED = "[secret]"


class Span(NamedTuple):
    """Code points from ``start`` to before ``end``; ordered by start, then kind as listed."""

    start: int
    rank: int
    end: int

    def __str__(self) -> str:
        return f"{KINDS[self.rank]}:{self.start}:{self.end}"


def checksum(body: str) -> str:
    """CRC-32 in six digits of base 62, the form that these tokens end in."""
    number, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        number, digit = divmod(number, 62)
        out = BASE62[digit] + out
    return out


class Scanner:
    def __init__(self) -> None:
        self.words = ahocorasick.Automaton()
        for rank, words in ((0, ASSIGN_WORDS), (1, ("akia",)), (3, CHECKED_WORDS)):
            for word in words:
                self.words.add_word(word, (rank, len(word)))
        self.words.make_automaton()
        digits = b"0123456789abcdef"
        self.digits = bytes(ord("h") if b in digits else 0 for b in range(256))

    def scan(self, text: str | None) -> list[Span]:
        """All spans in order."""
        if not text:
            return []
        raw = text.encode()
        spans = []
        # ASCII letters only in lower case, so that code points keep their places.
        hits = sorted(
            (end - size + 1, rank) for end, (rank, size) in self.words.iter(raw.lower().decode())
        )
        free = [0] * len(KINDS)
        for start, rank in hits:
            if start < free[rank]:
                continue
            match = (ASSIGN, ACCESS, HEX, CHECKED)[rank].match(text, start)
            if match is None:
                continue
            free[rank] = match.end()
            if rank == 0 and len(match[2]) < ASSIGN_LEAST:
                continue
            if rank == 1 and len(match[0]) < ACCESS_LEAST:
                continue
            if rank == 3 and checksum(match[1]) != match[2]:
                continue
            spans.append(Span(start, rank, match.end()))
        if raw.translate(self.digits).find(b"h" * HEX_LEAST) >= 0:
            spans += [Span(m.start(), 2, m.end()) for m in HEX.finditer(text)]
        return sorted(spans)

    def redact(self, text: str | None) -> str | None:
        """The text with each stretch of spans replaced; NULL stays NULL."""
        spans = self.scan(text)
        if not spans:
            return text
        out, at = [], 0
        for start, _, end in spans:
            if start > at or not out:
                out += [text[at:start], REDACTED]
            at = max(at, end)
        return "".join([*out, text[at:]])


def find_secrets(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_assign, n_access, n_hex, base_sha256, spans`` for each row.

    Spans are ``kind:start:end`` by start, then kind; ``base_sha256`` digests those of the
    first three kinds. NULL and empty texts have none (digest of the empty string).
    Repeated rows are scanned each; an empty table gives none; other columns are not read.
    No shuffle.
    """

    def make():
        scan = Scanner().scan

        def work(texts: list[str | None]) -> list:
            found = [scan(t) for t in texts]
            counts = [[sum(s.rank == k for s in spans) for spans in found] for k in range(3)]
            base = [",".join(str(s) for s in spans if s.rank < 3) for spans in found]
            every = [",".join(map(str, spans)) for spans in found]
            return [*counts, [hashlib.sha256(b.encode()).hexdigest() for b in base], every]

        return work

    return map_texts(
        df, [key], text, make,
        "n_assign long, n_access long, n_hex long, base_sha256 string, spans string",
    )


def redact_secrets(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``keys`` and ``redacted``: the text with every span replaced by a placeholder."""

    def make():
        redact = Scanner().redact
        return lambda texts: [[redact(t) for t in texts]]

    return map_texts(df, keys, text, make, "redacted string")
