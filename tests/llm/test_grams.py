"""n-grams are of characters in lower case, whatever their number of bytes."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from chronofold.llm import grams

TEXTS = ["Ça va été", "ÇA VA ÉTÉ", "Привет мир привет", "中文 字", "مرحبا", "😀", "plain text", "", None, "Straße ΣΑΣ"]


@pytest.mark.parametrize("least,most", [(3, 6), (1, 3)])
def test_characters(least, most):
    found = {}
    for row, gram, times in grams.distinct(pa.array(TEXTS), least, most, 40):
        for r in np.unique(row).tolist():
            found[r] = sorted(times[row == r].tolist()), gram[row == r].tolist()
    for i, text in enumerate(TEXTS):
        words = [f" {w.lower()} " for w in (text or "").split()]
        want = Counter(w[a : a + n] for w in words for n in range(least, most + 1) for a in range(len(w) - n + 1))
        assert found.get(i, ([], []))[0] == sorted(want.values())
    assert found[0] == found[1]
