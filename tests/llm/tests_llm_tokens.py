"""Token ids straight from the tokenizer, for comparison."""

from functools import lru_cache

from tokenizers import Tokenizer

from sprank.llm.packing import END_ID, default_tokenizer


@lru_cache
def _tokenizer():
    return Tokenizer.from_file(default_tokenizer())


def ids_of(text):
    return [*_tokenizer().encode(text or "", add_special_tokens=False).ids, END_ID]
