"""Overlaps in texts whose cuts lie far apart."""

import os
import random

import numpy as np
import pytest

from partwise.llm.tokens import VOCABULARY, encoding

pytestmark = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary file")

from partwise.llm.chunking import cut_text  # noqa: E402


def test_overlap_is_kept_where_cuts_are_far_apart():
    r = random.Random(5)
    words = ["".join(r.choice("环肽保留了质量参照划分放在同一侧渗透率") for _ in range(r.randrange(20, 45))) for _ in range(120)]
    text, enc, limits = "，".join(words) + "。", encoding().encode_ordinary, [(128, 16), (256, 64)]
    p = np.array(cut_text(text, limits)).reshape(-1, 8)
    for i, (limit, overlap) in enumerate(limits):
        rows = p[p[:, 0] == i]
        assert (rows[:, 4] <= limit).all() and all(n == len(enc(text[s:e])) for s, e, n in rows[:, 2:5].tolist())
        short = [(n, shared) for n, shared in rows[1:, 4:6].tolist() if shared < overlap and n + overlap - shared < limit - 2]
        assert len(rows) > 5 and not short, short
