"""The corpus pipeline against the stages put together by hand."""

import random
import zlib

import numpy as np
import pytest

from .test_corpus import classes, encoder, plain_lines  # noqa: F401
from .test_rows import grams


def test_stages_take_effect(spark, tmp_path, encoder):  # noqa: F811
    pipeline = pytest.importorskip("corpus_pipeline")
    from siteglass.llm import line_dedup, quality

    def text(i, n=8):
        rng = random.Random(i)
        return "\n".join(" ".join("".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(2, 8))) for _ in range(14)) + "." for _ in range(n))

    item = "this very sentence belongs to a test set and must not be learned by heart from any corpus"
    docs = [(1, text(1)), (2, text(1)), (3, text(3) + "\nAll rights reserved."), (4, "junk%%% " * 50), (5, text(5) + "\n" + text(3, 1)), (6, text(6) + "\n" + item.upper() + "."), (7, None), (8, ""), (9, text(9, 40))]
    spark.createDataFrame([(d, t, "en", None, len(t or ""), "x", 1) for d, t in docs], "doc_id long, text string, lang string, source string, n_chars long, n_removed string, key int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = [(d, j[7]) for d, t in docs if (j := quality.judge(t, quality.Rules()))[6]]
    gone = plain_lines(kept, line_dedup.Params())
    kept = [(d, "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d])) for d, t in kept]
    kept = [(d, t) for d, t in kept if t.split()]
    _, root = classes(kept, 5)
    kept = [(d, t) for d, t in kept if root[d] == d and not 100 * len(grams(item) & grams(t)) >= 80 * len(grams(item))]
    assert [d for d, _ in kept] == [1, 3, 5, 9]
    got = {}
    for r in sorted(pipeline.run(spark, str(tmp_path)).collect(), key=lambda r: (r.doc_id, r.start)):
        got.setdefault(r.doc_id, []).append(r)
    assert set(got) == {d for d, _ in kept}
    for d, t in kept:
        ids = np.array([*encoder.tok.encode(t, add_special_tokens=False).ids, 0], dtype="<u4")
        assert sum(r.length for r in got[d]) == len(ids)
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in got[d])
    assert [n for n, _ in pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "decontamination", "packing"]


def test_line_stage_folds_copies_of_short_lines(spark, frame):
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(11)
    lines = ["And ornd.", " And ornd. ", "And  ornd.", "and ornd.", "x", "", " ", "\t", "\u00a0", "\u200b\u3000", "这是一行没有空格的中文文本", "https://a.b/" + "c" * 90, "a\tb\tc\td\te\tf", "one two three four", "one two three fore", "a b c d e f", "a b c d e g", "a b", "b a", "ab"]
    docs = [(d, "\n".join(rng.choice(lines) for _ in range(rng.randint(1, 9)))) for d in range(40)]
    seen, want = set(), {}
    for d, t in docs:
        kept = []
        for line in t.split("\n"):
            if (x := line.strip(" ")) not in seen or not x.strip("\t\u00a0\u200b\u3000"):
                kept.append(line)
            seen.add(x)
        if kept == t.split("\n") or "".join(kept).strip(" \t"):
            want[d] = "\n".join(kept)
    got = {r.doc_id: r.text for r in pipeline.line_deduplication(spark, frame(docs), "").collect()}
    assert got == want and sum(len(t) for _, t in docs) > 2 * sum(map(len, got.values()))
