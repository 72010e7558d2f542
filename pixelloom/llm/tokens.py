"""Token ids of whole texts by a public tokenizer file."""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa

from pixelloom.llm.common import binary

DEFAULT_TOKENIZER = "word_bpe_49k.json"
#: A stop or comma that ends a word of letters or digits.
CLOSING = re.compile(rb"[.,](?<=[a-z0-9][.,])(?=[ \n])")


def tokenizer_path(name: str = DEFAULT_TOKENIZER) -> str:
    """Where the installed package of public vocabularies keeps ``name``."""
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder:
    """Ids of a text, word by word, with the ids of earlier words remembered.

    It suits tokenizers that never join what ASCII white space separates, nor a letter with the
    stop after it, and that ignore the case of A-Z, such as the default one: it splits before
    anything is merged, and no Unicode composition crosses a space. So A-Z are lower-cased and
    closing stops set apart first, which leaves fewer different words. ``remember`` bounds the
    number of words kept.
    """

    def __init__(self, path: str, remember: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.remember = remember
        self.known: dict[bytes, bytes] = {}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        #: ids that end a word, for vocabularies that mark them so
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        if suffix := getattr(self.tokenizer.model, "end_of_word_suffix", None):
            self.ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True

    @staticmethod
    def words(text: bytes | None) -> list[bytes]:
        if not text:
            return []
        # names of special tokens keep their case, and so does what a combining mark may follow
        if b"<|" in text or b"\xcc" in text or b"\xcd" in text:
            return text.split()
        return CLOSING.sub(rb" \g<0>", text.lower()).split()

    def _learn_each(self, words: list[bytes]) -> None:
        found = self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)
        for word, e in zip(words, found):
            self.known[word] = array("I", e.ids).tobytes()

    def _learn(self, words: Iterable[bytes], at_once: int = 512) -> None:
        """Add words to ``known``. Words of letters are encoded many in a line and cut at the ids that end a word."""
        letters, others = [], []
        for word in words:
            (letters if word.isalpha() or word.decode().isalpha() else others).append(word)
        lines = [letters[k : k + at_once] for k in range(0, len(letters), at_once)]
        found = self.tokenizer.encode_batch_fast([b" ".join(ws).decode() for ws in lines], add_special_tokens=False)
        for own, e in zip(lines, found):
            ids = np.array(e.ids, dtype="<u4")
            cuts = ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()
            if len(cuts) == len(own):
                data = ids.tobytes()
                self.known.update(zip(own, [data[x:y] for x, y in zip([0, *cuts], cuts)]))
            else:  # a letter came apart, or nothing marks the ends
                others += own
        self._learn_each(others)

    def encode(self, texts: Iterable[bytes | None], end: bytes = b"") -> list[np.ndarray]:
        """For each UTF-8 text (null: empty) its ids as unsigned 32-bit integers, closed by ``end``."""
        known = self.known
        words = [self.words(t) for t in texts]
        every = set(chain.from_iterable(words))
        new = every.difference(known)
        if len(known) + len(new) > self.remember:
            # what stands in these texts stays; that has most of the frequent words
            known = self.known = {w: known[w] for w in every if w in known}
        self._learn(new)
        return [np.frombuffer(b"".join(map(known.__getitem__, ws)) + end, dtype="<u4") for ws in words]


def encoded(
    column: pa.Array, encoder: WordEncoder, end_id: int, step: int = 256
) -> Iterator[tuple[int, np.ndarray]]:
    """Row number and ids with the closing ``end_id``, a few texts at a time."""
    end = np.array([end_id], dtype="<u4").tobytes()
    for at in range(0, len(column), step):
        for i, ids in enumerate(encoder.encode(binary(column.slice(at, step)), end)):
            yield at + i, ids
