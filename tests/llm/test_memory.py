import re
import sys
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from alpenglow.llm import vector


def mapped_mb():
    return int(re.search(r"RssAnon:\s+(\d+)", Path("/proc/self/status").read_text())[1]) / 1024


@pytest.mark.skipif(not sys.platform.startswith("linux"), reason="reads /proc")
def test_texts_give_back_what_a_block_has_freed():
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["some text", None])], names=["doc_id", "text"])
    before, kept = mapped_mb(), []
    for _, raw in vector.texts(iter([batch] * 3)):
        assert raw == [b"some text", b""]
        arrays = [np.ones(8_000) for _ in range(2_000)]  # 64 KB each: 128 MB beside what stays
        kept += arrays[::100]
        del arrays
        vector.PrefixHash(np.zeros(10, np.uint8))
    assert len(kept) == 60 and mapped_mb() - before < 40
    assert not vector.PrefixHash._powers
