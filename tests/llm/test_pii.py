from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from gleaner.llm import pii


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (2 if i % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def plain(text):
    text, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end(), "email"))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m.group().split(".")):
            out.append((m.start(), 1, m.end(), "ip"))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m.group())
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end(), "card"))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append((m.start(), 3, m.end(), "phone"))
    return sorted(out)


TEXTS = [
    None, "", "a@b.c_d@e.f", "x..y@a.b..c.d.", "a@b.c@d.e.f", "1.2.3.4.5.6.7.8", "256.1.1.1.2", "0000255.1.2.003",
    "4111 1111 1111 1111", "4111-1111 1111  1111", "4111111111111111 27.65.1.2", "+1 (252) 555-8630.", "+123456789012345678",
    "é😀 a@b.co +49 (30) 1234567 日本", "a" * 50_000, "1" * 50_000, "@" * 3_000, "+" * 3_000, "+1" + " " * 20_000,
    "1 " * 10_000, "1." * 1_000, "a." * 10_000 + "@" + "b." * 10_000, "a@" + "b." * 10_000 + "c", "\n" * 1_000,
]


def test_base_spans_agree_with_the_plain_patterns(spark):
    rng = random.Random(3)
    alphabet = ["a", "B", "1", "2", "9", " ", "-", ".", "@", "+", "_", "%", "(", ")", "é", "\n", "😀", "12", "4111111111111111", " 1"]
    texts = TEXTS + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60))) for _ in range(3_000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(4)
    rows = {r["doc_id"]: r["pii"] for r in pii.find(df.withColumn("pii", F.lit(1))).collect()}
    for i, text in enumerate(texts):
        assert [(s["start"], s["rank"], s["end"], s["kind"]) for s in rows[i] if s["base"]] == plain(text), repr((text or "")[:80])


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("DE89 3704 0044 0532 0130 00 and", ["iban"]),
        ("GB82WEST12345698765432", ["iban"]),
        ("GB82WEST12345698765431", []),
        ("XX82WEST12345698765432", []),
        ("ssn 123-45-6789", ["ssn"]),
        ("part 123-45-6789", []),
        ("ssn 000-45-6789", []),
        ("call (212) 555-1234", ["phone"]),
        ("code (212) 555-1234", []),
        ("4111111111111111 27", ["card"]),
        ("order 4111111111111111 27", []),
    ],
)
def test_more_kinds_need_a_checksum_or_words_nearby(value, text, found):
    spans = value(pii.spans(F.col("t")), t=text)
    assert [s["kind"] for s in spans if not s["base"]] == found
    assert all(s["score"] >= pii.LEAST_SCORE for s in spans if not s["base"])


def test_context_moves_the_score(value):
    plain_score = value(pii.spans(F.col("t")), t="see 10.0.0.1 there")[0]["score"]
    assert value(pii.spans(F.col("t")), t="host 10.0.0.1 there")[0]["score"] > plain_score
    assert value(pii.spans(F.col("t")), t="version 10.0.0.1 there")[0]["score"] < plain_score


def test_redaction_and_edges(spark, odd, none):
    df = spark.createDataFrame([(1, "é a@b.co or +49 (30) 1234567"), (2, None), (3, "")], "doc_id int, text string")
    assert [r["text"] for r in pii.redact(df).orderBy("doc_id").collect()] == ["é [EMAIL] or [PHONE]", None, ""]
    assert pii.find(odd).count() == odd.count() and pii.find(none).collect() == []
    assert pii.find(odd).where("size(pii) > 0").count() == 0
