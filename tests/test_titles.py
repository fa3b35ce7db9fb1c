"""Titles against questions: results by brute force, and counts made where the titles are."""

import re
from itertools import pairwise

from quillmill.operators import retrieval


def test_titles_are_matched_and_counted_in_parts_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "TITLES", 10, raising=False)
    titles = [(i, ["steel gears", "gear box", "x", "", None, "wide bolt bolts", "a b c", "큰 볼트 규정", "abcdefgh"][i % 9]) for i in range(81)]
    asked = [(1, "gears and bolts"), (2, "규정 볼트 x"), (3, ""), (4, "boxes abc")]
    words = lambda t: {w for w in re.findall(r"[^\W_]+", (t or "").lower()) if len(w) >= 2}
    pairs = lambda t: {"".join(p) for w in words(t) for p in pairwise(w)}
    want = {}
    for i, title in titles:
        for q, text in asked:
            ratio = len(pairs(title) & pairs(text)) / max(1, len(pairs(title)))
            if words(title) & words(text) or ratio >= 0.15:
                want[q, i] = 0.15 if words(title) & words(text) or ratio >= 0.30 else 0.05
    found = retrieval.title_boosts(spark.createDataFrame(asked, "query_id long, text string"), spark.createDataFrame(titles, "id long, title string"))
    assert {(r["query_id"], r["id"]): r["boost"] for r in found.collect()} == want and len(set(want.values())) == 2
    plan = found._jdf.queryExecution().sparkPlan().toString() + found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert "hashpartitioning(id" in plan and "hashpartitioning(query_id" not in plan  # counted in the parts, not first in the table's splits
