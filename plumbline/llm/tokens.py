"""Token ids of whole texts under a public byte-level vocabulary.

Two public libraries read the same vocabulary and give the same ids. `tiktoken`
takes ordinary text, being several times faster; a part with a very long word or
a very long run of white space, on which its pattern would overflow the stack
and its merging take quadratic time, goes to `tokenizers`.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

VOCABULARY = "byte_bpe_50k"  # as .json and as .tiktoken
_CUT = re.compile(r"(?<=[A-Za-z一-鿿가-힣])(?=\W)")
LONG = 1024
_BLANKS = re.compile(rf"\s{{{LONG}}}")


@lru_cache(maxsize=4)
def encoding(path: str | None = None) -> tiktoken.Encoding:
    """The encoder of a rank file; without a path, of VOCABULARY among the installed files."""
    with open(path or public_tokenizers.path(f"{VOCABULARY}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def tokenizer(path: str | None = None) -> Tokenizer:
    found = Tokenizer.from_file(path or public_tokenizers.path(f"{VOCABULARY}.json"))
    found.encode_special_tokens = True
    return found


def parts(text: str, size: int = 1 << 18) -> Iterator[str]:
    """A long text in parts that are encoded alike alone and together.

    A piece of the pattern that ends in a letter goes on with letters only, and
    the pattern never looks back: a cut between a letter and what is none
    changes no id.
    """
    begin = 0
    while len(text) - begin > 2 * size:
        cut = _CUT.search(text, begin + size)
        if cut is None:
            break
        yield text[begin : cut.start()]
        begin = cut.start()
    yield text[begin:] if begin else text


def has_long_run(text: str) -> bool:
    """Whether LONG characters in a row are white space, or none of them is."""
    sizes = [len(w) for w in text.split()]
    spare = len(text) - sum(sizes) - len(sizes)  # white space beyond one a word
    return max(sizes, default=0) >= LONG or spare >= LONG - 2 and _BLANKS.search(text) is not None


def encode(text: str, ranks: str | None = None, vocabulary: str | None = None) -> np.ndarray:
    """Ids of a whole text; strings of special tokens are ordinary text. The paths are those of one vocabulary in both forms."""
    found = []
    for part in parts(text):
        if has_long_run(part):
            found.append(np.array(tokenizer(vocabulary).encode(part, add_special_tokens=False).ids, np.uint32))
        else:
            found.append(np.array(encoding(ranks).encode_ordinary(part), np.uint32))
    return found[0] if len(found) == 1 else np.concatenate(found)
