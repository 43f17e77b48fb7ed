"""Word and search-term expressions, and the tokenizer plug-in."""

from __future__ import annotations

import base64
from typing import Protocol

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import NOT_WS, WS, has_rare_space, let, plain_spaces, strip

# fixed value: what counts as one search term
SEARCH_TERM = r"\b[a-zA-Z0-9]+(?:[-/][a-zA-Z0-9]+)*\b"


def word_count(c: Column) -> Column:
    return F.regexp_count(plain_spaces(c), F.lit(r"\S+"))


def word_pieces(c: Column) -> Column:
    """Words with the white space after them; joined they give the text again.

    White space before the first word stays with that word.
    """

    def joined_start(p: Column) -> Column:
        head = F.array(F.concat(F.get(p, 0), F.get(p, 1)))
        return (
            F.when(strip(F.get(p, 0)) != "", p)
            .when(F.size(p) > 1, F.concat(head, F.slice(p, 3, F.greatest(F.size(p), F.lit(1)))))
            .otherwise(F.array().cast("array<string>"))
        )

    quick = let(F.split(c, r"(?<=\s)(?=\S)", -1), joined_start)
    exact = F.regexp_extract_all(c, F.lit(rf"(?:\A{WS}+)?{NOT_WS}+{WS}*"), 0)
    return F.when(has_rare_space(c), exact).otherwise(quick)


def search_terms(c: Column) -> Column:
    """Lower-case terms; one-letter terms are dropped, digits are kept.

    ``(?U)`` makes the word boundary Unicode-aware on every Java version, so a
    term glued to an accented letter is skipped.
    """
    found = F.regexp_extract_all(F.lower(c), F.lit(rf"(?U){SEARCH_TERM}"), 0)
    return F.filter(
        F.coalesce(found, F.array().cast("array<string>")),
        lambda t: (F.length(t) > 1) | t.between("0", "9"),
    )


class Tokenizer(Protocol):
    """A sub-word tokenizer.  It is pickled to the tasks."""

    def encode(self, text: str) -> list[int]: ...

    def decode(self, tokens: list[int]) -> str: ...


class WordTokenizer:
    """Words as tokens; the default, and what the native chunker computes."""

    def __init__(self) -> None:
        self._pieces: dict[int, str] = {}
        self._ids: dict[str, int] = {}

    def encode(self, text: str) -> list[int]:
        import re

        out = []
        for piece in re.findall(r"(?:\A\s+)?\S+\s*", text):
            number = self._ids.setdefault(piece, len(self._ids))
            self._pieces[number] = piece
            out.append(number)
        return out

    def decode(self, tokens: list[int]) -> str:
        return "".join(self._pieces[t] for t in tokens)


class BpeTokenizer:
    """Byte-pair tokens from a local rank file (``base64 rank`` per line).

    The file must be readable by every task, e.g. shipped with ``--files``.
    Special-token text is encoded like any other text.
    """

    def __init__(self, path: str, pattern: str) -> None:
        self.path = path
        self.pattern = pattern
        self._encoding = None

    def __getstate__(self) -> dict:
        return {"path": self.path, "pattern": self.pattern, "_encoding": None}

    @property
    def encoding(self):
        if self._encoding is None:
            import tiktoken

            ranks = {}
            with open(self.path, "rb") as lines:
                for line in lines:
                    if line.strip():
                        token, rank = line.split()
                        ranks[base64.b64decode(token)] = int(rank)
            self._encoding = tiktoken.Encoding(
                name="local", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={}
            )
        return self._encoding

    def encode(self, text: str) -> list[int]:
        return self.encoding.encode(text, disallowed_special=())

    def decode(self, tokens: list[int]) -> str:
        return self.encoding.decode(tokens)
