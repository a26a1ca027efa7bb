"""Token ids of whole texts by the tokenizers library, one space-led chunk at a time.

The library spends microseconds on every word it sees, also on words it has just seen. A text is therefore cut only
where the cut can't change the result, each distinct chunk is encoded by the library once per Python worker, and a
bounded worker cache answers the rest. Every id comes from the library.

Where cutting is neutral:

* Byte-level vocabularies split texts by ``PATTERN`` before merging. A run of white space and the following run of
  other characters lie in one chunk, so no match of the pattern spans two chunks. A comma or full stop right after a
  letter or digit starts a match, so a cut before it is neutral too.
* The word vocabulary drops white space and never merges across it, so a cut at a space or newline is always neutral.
"""

from __future__ import annotations

import json
import re
import struct
from functools import lru_cache

#: White space of the pattern's ``\s``, as a character class without its brackets (fixed values: Unicode White_Space).
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_CHUNK = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
_RARE_WHITE = re.compile("[\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]")
#: A comma or full stop that does not follow a letter or digit; those that do start a pre-token of their own.
_LOOSE_MARK = re.compile("(?<![A-Za-z0-9\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\u024f])[.,]")
#: Stands before a chunk that follows the one before it without a space.
_JOINED = "\x01"
_TAIL = ".,!?;:#$%&*|\"')>"
#: Letters below this have the same class in every Unicode version and are stable under NFC.
_SAFE_BELOW = "ɐ"
#: Chunks kept by one generation of a worker's cache (there are two), and the longest chunk kept.
CACHE_ENTRIES, CACHE_CHARS = 300_000, 48


@lru_cache(maxsize=1)
def byte_characters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others follow from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {b: chr(b) for b in printable}
    rest = (b for b in range(256) if b not in table)
    return table | {b: chr(0x100 + n) for n, b in enumerate(rest)}


_SPACE = byte_characters()[0x20]


def to_byte_characters(text: str) -> str:
    return text.encode().decode("latin-1").translate(byte_characters())


def load(path: str):
    """The tokenizer of a ``.json`` file, as the library reads it."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def is_word_level(path: str) -> bool:
    """Whether the file's pre-tokenizer drops white space (and its words carry an end mark)."""
    with open(path) as f:
        return bool(json.load(f)["model"].get("end_of_word_suffix"))


def plain_chunks(text: str) -> bool:
    """Whether every space and newline follows something else than white space, so that each starts a chunk."""
    if "  " in text or "\n " in text or " \n" in text or "\n\n" in text:
        return False
    if "\t" in text or "\r" in text or "\v" in text or "\f" in text or _JOINED in text:
        return False
    return text.isascii() or not _RARE_WHITE.search(text)


def plain_word(word: str) -> bool:
    """Whether a word is of letters only that normalisation leaves alone."""
    return word.isalpha() and (word.isascii() or max(word) < _SAFE_BELOW)


class ChunkTable(dict):
    """The value of each chunk. Without ``lead`` chunks are encoded as they stand; with it a chunk stands for itself after
    one space, unless it starts with a newline or the mark of a joined chunk.

    A bounded cache of two generations: a full table becomes the old one, and chunks that are met again move back.
    """

    def __init__(self, encoder: ChunkEncoder, lead: bool):
        self.encoder, self.lead, self.old = encoder, lead, {}

    def __missing__(self, chunk: str):
        value = self.old.get(chunk)
        if value is None:
            value = self.encoder.chunk_value(chunk, self)
        if len(chunk) <= CACHE_CHARS:
            if len(self) >= CACHE_ENTRIES:
                self.old = self.copy()
                self.clear()
            self[chunk] = value
        return value


class ChunkEncoder:
    """Encodes texts chunk by chunk. ``value`` turns a list of ids into what is kept; the value of two lists in a row must
    be the sum of their values, as with packed bytes or lengths."""

    def __init__(self, tokenizer, word_level: bool, value):
        self.tokenizer, self.model, self.word_level, self.value = tokenizer, tokenizer.model, word_level, value
        self.exact, self.spaced = ChunkTable(self, False), ChunkTable(self, True)
        self.words = self.exact, self.spaced
        self.marks: dict = {}

    def library_value(self, text: str):
        return self.value(self.tokenizer.encode(text, add_special_tokens=False).ids if text else [])

    def chunk_value(self, chunk: str, table: ChunkTable):
        """A chunk is often a word with trailing punctuation: the word is one pre-token for the model, and the
        punctuation after a letter is always a pre-token of its own."""
        lead = table.lead and chunk[:1] not in ("\n", _JOINED)
        if table.lead and chunk[:1] == _JOINED:
            chunk = chunk[1:]
        whole = " " + chunk if lead else chunk
        word = chunk.lower() if self.word_level else chunk
        if plain_word(word):
            shown = word if word.isascii() else to_byte_characters(word)  # ASCII letters stand for themselves
            return self.value([t.id for t in self.model.tokenize(_SPACE + shown if lead else shown)])
        core = chunk.rstrip(_TAIL)
        tail, head = chunk[len(core):], ""
        if core[:1] == "\n" and not self.word_level:
            head, core = "\n", core[1:]
        if core[:1] == " ":
            lead, core = True, core[1:]
        if not plain_word(core.lower() if self.word_level else core):
            return self.library_value(whole)
        value = self.words[lead][core]
        if head:
            value = self.mark_value(head) + value
        return value + self.mark_value(tail) if tail else value

    def mark_value(self, marks: str):
        value = self.marks.get(marks)
        if value is None:
            value = self.library_value(marks)
            if len(marks) <= CACHE_CHARS and len(self.marks) < CACHE_ENTRIES:
                self.marks[marks] = value
        return value

    def values(self, text: str):
        """The kept values of a text's chunks, in order."""
        if self.word_level:
            return map(self.exact.__getitem__, text.replace("\n", " ").split(" "))
        if plain_chunks(text):
            if not _LOOSE_MARK.search(text):  # words with marks behind them are no entries of their own
                text = text.replace(",", " " + _JOINED + ",").replace(".", " " + _JOINED + ".")
            chunks = text.replace("\n", " \n").split(" ")
            first = self.exact[chunks[0]]
            chunks = map(self.spaced.__getitem__, chunks)
            next(chunks)
            return _after(first, chunks)
        return map(self.exact.__getitem__, _CHUNK.findall(text))


def _after(first, rest):
    from itertools import chain

    return chain((first,), rest)


_PACKERS = [struct.Struct(f"<{n}I").pack for n in range(64)]


def pack(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    n = len(ids)
    return _PACKERS[n](*ids) if n < 64 else struct.pack(f"<{n}I", *ids)


@lru_cache(maxsize=4)
def id_encoder(path: str) -> ChunkEncoder:
    """This worker's encoder of a ``.json`` vocabulary; it keeps packed little-endian unsigned 32-bit ids."""
    return ChunkEncoder(load(path), is_word_level(path), pack)


def encode_packed(path: str, text: str) -> bytes:
    """A text's ids as little-endian unsigned 32-bit integers."""
    return b"".join(id_encoder(path).values(text))
