import numpy as np
import pytest

from mixtally.llm import substring_bytes
from mixtally.llm.textops import U64


@pytest.mark.parametrize("every", [1, 3])
def test_grams_of_hash_0_are_anchors(monkeypatch, every):
    """Each window within a document has an anchor, and none across documents, though many hashes begin with 32 zeros."""
    real = substring_bytes.byte_grams
    monkeypatch.setattr(substring_bytes, "byte_grams", lambda data, n: np.where(np.arange(len(g := real(data, n))) // 70 % every == 0, g & U64(0xFFFFFFFF), g))
    data = np.random.default_rng(2).integers(97, 123, 900).astype(np.uint8)
    offs = np.array([0, 99, 400, 900])
    x = substring_bytes.Anchors(data, offs)
    found = {w for at, near, far in zip(x.at, x.near, x.far) for w in range(at - far, at - near + 1)}
    assert found == {w for a, b in zip(offs, offs[1:]) for w in range(a, b - substring_bytes.WINDOW + 1)}
