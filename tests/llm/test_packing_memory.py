"""What a packing worker remembers stays small enough beside a full JVM."""

import os

import pytest

pytest.importorskip("tokenizers")

from eventloom.llm import packing
from eventloom.llm.queries import vocabulary


def test_memo_is_bounded_and_ids_stay_right():
    enc = packing.ChunkEncoder(vocabulary("word_bpe_49k.json"))
    step, most = 15_000, 0
    for at in range(0, 30 * step, step):
        text = " ".join("".join("etaoinshrdlu"[int(d, 12)] for d in _base12(i)) for i in range(at, at + step))
        (ids,) = enc.encode([text])
        most = max(most, len(enc.codes))
    assert most <= 400_000 + step
    assert ids.tolist() == enc.tok.encode(text, add_special_tokens=False).ids
    assert os.environ["TOKENIZERS_PARALLELISM"] == "false"


def _base12(i: int) -> str:
    out = ""
    while True:
        i, r = divmod(i, 12)
        out = "0123456789ab"[r] + out
        if not i:
            return out
