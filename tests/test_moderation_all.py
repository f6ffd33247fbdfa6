"""Moderation of all documents, in any script, against brute force."""

import re
import unicodedata

from gatewarden.plans import requests as plans

TEXTS = [
    "Open the ＳＥＡＲＣＨ　ＰＡＮＥＬ now", "the “search” big panel…", "search panel", "night desk and café", "ｎｉｇｈｔ desk 🙂", "Ночной стол", "我们的 partner feed。", "standing—desk", "Ｎｕｄｅ",
    "𝐍ight desk", "ﬁnal score of £3", "¿link offer?", "", None, "  ", "เวลา shown times ครับ", "نص", "link a b offer", "FOLDING DESK LAMP é",
]


def _brute(text):
    low = unicodedata.normalize("NFKC", (text or "").lower()).translate(str.maketrans("013457", "oieast"))
    n = re.sub(r"\s+", " ", "".join(" " if unicodedata.category(c).startswith("P") else c for c in low)).strip()
    words = n.split(" ")
    hits = [t for t in sorted(plans._TERMS) for a, b in [t.split()] if any(w == a and b in words[i + 1 : i + 3] for i, w in enumerate(words))]
    cats = [c for c, ks in plans._WORDS.items() if any(f" {k} " in f" {n} " for k in ks)]
    return n, ",".join(hits), min(len(hits) / 10, 1.0), "unsafe" if hits else "clean", ",".join(cats), round(min(len(cats) * 0.15, 1), 3)


def test_documents_of_all_scripts_are_moderated(spark, tmp_path):
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = {i: _brute(t) for i, t in enumerate(TEXTS)}
    rows = lambda q: {r[0]: tuple(r)[1:] for r in plans.QUERIES[q](spark, str(tmp_path)).collect()}
    assert rows("text_normalize") == {i: w[:1] for i, w in want.items()}
    assert rows("moderation_hits") == {i: w[1:2] for i, w in want.items()}
    assert rows("moderation_verdict") == {i: w[2:4] for i, w in want.items()}
    assert rows("keyword_categories") == {i: w[4:] for i, w in want.items()}
    assert want[0][3] == want[4][3] == "unsafe" and want[8][4] == "NSFW"
