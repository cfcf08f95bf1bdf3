r"""Encoding with a tokenizers file, with a memo of blank-separated pieces in front of the library.

Both tokenizer files used here split a text before they merge, and always before a blank that another
character follows; so the ids of a text are the ids of its blank-separated pieces in a row, each with its
blank in front. A line end between two other characters is split off as well. Prose repeats its words: a worker
keeps the ids that the library gave for a piece and asks it only for new ones. Texts with runs of blanks, other
white space, or the name of an added token go to the library whole, and so does every text if the file is not of
one of the two shapes (`BYTES`, `WORDS`) for which this holds. Either way the ids are those of
`Tokenizer.encode(text, add_special_tokens=False)`: the name of an added token in a text gives that token's id.
"""

from __future__ import annotations

import json
import os
import re
import sys
from array import array
from functools import lru_cache

#: Pieces after which a worker's memo forgets those not asked for lately: bounds its memory.
MEMO, TAILS = 400_000, 10_000

#: White space that pieces must not be cut at: any but single blanks and line ends.
ODD_SPACE = re.compile("[\t\x0b\x0c\r\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]")
#: Punctuation that may stand behind a word.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Characters whose lower case is one plain character in any Unicode version.
PLAIN = re.compile(r"[\n\x20-\x7E\xC0-\xFFĀ-įı-ňŊ-ž]*")
#: Words of letters that are the same in every Unicode version and have no other normal form.
LETTERS = re.compile("[A-Za-z\xC0-\xD6\xD8-\xF6\xF8-\xFFĀ-įı-ňŊ-ž]+")


def spelled() -> dict[int, str]:
    """How byte-level vocabularies spell bytes: printable Latin-1 as itself, the others in order from U+0100."""
    odd = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b)]
    return {b: chr(256 + i) for i, b in enumerate(odd)}


SPELLED = spelled()


#: The parts of a tokenizer file that decide where texts are split (fixed values): byte-level, and words in lower case.
BYTES = {"normalizer": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}}
WORDS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False},
    ]},
}


def splits_alike(shape: dict, known: dict) -> bool:
    """Whether a tokenizer file splits texts as `known` does and merges by plain byte-pair merges."""

    def bare(x):
        if isinstance(x, dict):
            return {k: bare(v) for k, v in x.items() if k != "trim_offsets"}
        return [bare(v) for v in x] if isinstance(x, list) else x

    model, odd = shape["model"], ("dropout", "unk_token", "continuing_subword_prefix", "ignore_merges", "byte_fallback")
    plain = model["type"] == "BPE" and not any(model.get(k) for k in odd) and not shape.get("post_processor")
    tokens = all(not t["normalized"] and not t["single_word"] for t in shape.get("added_tokens", []))
    return plain and tokens and all(bare(shape[k]) == v for k, v in known.items())


class Memo(dict):
    """piece -> ids. A piece that is not there is asked for and kept. When it is full the pieces asked for since the last
    time stay at hand, the others are forgotten."""

    def __init__(self, tok, blank: str, lower: bool, ends: "Memo | None" = None):
        self.tok, self.blank, self.lower, self.ends = tok, blank, lower, ends
        self.merge, self.lead = tok.model.tokenize, blank and SPELLED[32]
        self.tails: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.before.get(piece)
        if ids is None:
            ids = self.ask(piece)
        self[piece] = ids
        return ids

    def ask(self, piece: str) -> bytes:
        # a word of plain letters is one pre-token that no normalizer changes: the library's model takes it as it is
        if piece.isascii() and piece.isalpha() and (not self.lower or piece.islower()):
            return pack([t.id for t in self.merge(self.lead + piece)])
        if LETTERS.fullmatch(piece) and (not self.lower or piece == piece.lower()):
            return pack([t.id for t in self.merge(self.lead + piece.encode().decode("latin-1").translate(SPELLED))])
        word = piece.rstrip(PUNCTUATION)
        if word != piece and LETTERS.fullmatch(word):  # the library always splits between the two
            return self[word] + self.tail(piece[len(word) :])
        if self.ends is not None and "\n" in piece:
            first, *lines = piece.split("\n")
            if first and all(lines):  # single line ends between other characters
                return self[first] + b"".join(self.tail("\n") + self.ends[line] for line in lines)
        return pack(self.tok.encode(self.blank + piece, add_special_tokens=False).ids)

    def tail(self, text: str) -> bytes:
        if text not in self.tails:
            if len(self.tails) > TAILS:
                self.tails.clear()
            self.tails[text] = pack(self.tok.encode(text, add_special_tokens=False).ids)
        return self.tails[text]

    def turn(self) -> None:
        if len(self) > MEMO:
            self.before = dict(self)
            self.clear()


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task on each core already
        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            shape = json.load(f)
        self.lower = splits_alike(shape, WORDS)
        self.fits = self.lower or splits_alike(shape, BYTES)
        names = [t["content"] for t in shape.get("added_tokens", [])]
        #: texts that hold one of these are never cut at blanks
        self.names = re.compile("|".join(map(re.escape, names)), re.IGNORECASE) if names else re.compile(r"(?!)")
        #: pieces at the start of a text or line; where a blank stays in front of a piece, the others have a memo of their own
        self.bare = Memo(self.tok, "", self.lower)
        self.memo = self.bare if self.lower else Memo(self.tok, " ", False, self.bare)

    def whole(self, text: str) -> bytes:
        return pack(self.tok.encode(text, add_special_tokens=False).ids)

    def __call__(self, text: str) -> bytes:
        if not self.fits or "  " in text or ODD_SPACE.search(text) or self.names.search(text):
            return self.whole(text)
        self.memo.turn()
        self.bare.turn()
        if self.lower:
            if PLAIN.fullmatch(text):
                text = text.lower()
            return b"".join(map(self.memo.__getitem__, text.split()))
        if "\n" in text and text[0] not in " \n" and text[-1] != "\n" and not ("\n\n" in text or "\n " in text or " \n" in text):  # each line by itself: no two words with a line end between them become one piece
            return self.bare.tail("\n").join(map(self.line, text.split("\n")))
        first, *parts = text.split(" ")
        lines = first.split("\n")
        head = b"" if not first else self.bare.tail("\n").join(map(self.bare.__getitem__, lines)) if all(lines) else self.whole(first)
        return head + b"".join(map(self.memo.__getitem__, parts))

    def line(self, text: str) -> bytes:
        first, *parts = text.split(" ")
        return self.bare[first] + b"".join(map(self.memo.__getitem__, parts))


def pack(ids: list[int]) -> bytes:
    data = array("I", ids)
    if sys.byteorder == "big":
        data.byteswap()
    return data.tobytes()


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The worker's encoder of a file; made once in each worker."""
    return Encoder(path)
