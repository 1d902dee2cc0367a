"""Token ids of texts, with a memo of words that a Python worker keeps from task to task."""

from __future__ import annotations

import importlib
import os
import sys
import types
from collections.abc import Callable, Iterable

#: Words that a memo holds before it is thinned out: some 120 MB.
MOST_WORDS = 600_000


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file is: a path as it is, else a name of the installed collection."""
    return name if os.path.sep in name else importlib.import_module("public_tokenizers").path(name)


def of_worker(key, make: Callable):
    """An object that this Python process keeps: made once, and found again by later tasks of the same worker."""
    held = sys.modules.setdefault("_tidemark_worker", types.ModuleType("_tidemark_worker")).__dict__
    if key not in held:
        held[key] = make()
    return held[key]


def load_tokenizer(name: str, plain_specials: bool = False):
    """A tokenizer of the tokenizers library. With ``plain_specials`` the special tokens' strings in a text are ordinary text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    def make():
        t = Tokenizer.from_file(tokenizer_path(name))
        t.encode_special_tokens = plain_specials
        return t

    return of_worker(("tokenizer", name, plain_specials), make)


class Memo(dict):
    """What ``compute`` (from a list of words to a list of values) gives for each word.

    When it has grown to ``most`` words, only those of the call at hand stay: frequent words are among them.
    """

    def __init__(self, compute: Callable[[list], Iterable], most: int = MOST_WORDS):
        super().__init__()
        self.compute, self.most = compute, most

    def learn(self, words: Iterable) -> None:
        """After this, every one of ``words`` is held."""
        distinct = set(words)
        new = [w for w in distinct if w not in self]
        if len(self) + len(new) > self.most:
            kept = {w: self[w] for w in distinct if w in self}
            self.clear()
            self.update(kept)
        if new:
            self.update(zip(new, self.compute(new)))
