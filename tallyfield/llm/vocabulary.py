"""A byte-level BPE vocabulary given as a tiktoken rank file, built once per worker process."""

from __future__ import annotations

import base64
import hashlib

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
WORD_TOKENIZER = "/opt/tokenizers/word_bpe_49k.json"
# rank files are a few MB; more than this is not a vocabulary and is not sent to every task
LIMIT = 32 << 20

# fixed value: how this vocabulary's texts are split before merging
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_BUILT: dict[str, object] = {}


def read_ranks(path: str) -> bytes:
    """The rank file as the driver sees it; tasks get these bytes, not the path."""
    with open(path, "rb") as file:
        data = file.read(LIMIT + 1)
    if len(data) > LIMIT:
        raise ValueError(f"{path} has more than {LIMIT} bytes")
    return data


def encoding(data: bytes):
    key = hashlib.md5(data).hexdigest()
    if key not in _BUILT:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}
        _BUILT[key] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _BUILT[key]
