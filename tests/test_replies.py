from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from gleaner.functions import replies
from gleaner.operators import selfcheck


@pytest.mark.parametrize(
    ("raw", "cleaned"),
    [
        ("<think>plan\n{}</think>\n  # Text ", "# Text"),
        ("```markdown\n# Text\n\nmore\n```", "# Text\n\nmore"),
        ("  ```\nbody\n  ```  ", "body"),
        ("before ```\ncode\n``` after", "before ```\ncode\n``` after"),
        ("```\nnot closed", "```\nnot closed"),
        ("<THINK>a</THINK><think>b</think>x", "x"),
        ("Here is it:\n# Text", "Here is it:\n# Text"),
    ],
)
def test_clean_reply(value, raw, cleaned):
    assert value(replies.clean_reply("t"), t=raw) == cleaned


@pytest.mark.parametrize(
    ("raw", "cleaned", "nothing"),
    [
        ("NOTHING_HERE", "", True),
        (" nothing_here.. ", "", True),
        ("```\nNothing_Here\n```", "", False),
        ("NOTHING_HERE but more", "NOTHING_HERE but more", False),
        ("  ", "", True),
    ],
)
def test_nothing_here(value, raw, cleaned, nothing):
    assert value(replies.clean_fragment_reply("t"), t=raw) == cleaned
    assert value(replies.says_nothing("t"), t=raw) is nothing


@pytest.mark.parametrize(
    ("raw", "score", "feedback"),
    [
        ('{"feedback": "f", "score": 3}', 3, "f"),
        ('noise {"feedback": "f", "score": 9} noise', 5, "f"),
        ('<think>{"score": 5}</think>{"feedback": "f", "score": -2}', 1, "f"),
        ('{"feedback": "f", "score": 4.9}', 4, "f"),
        ('{"feedback": "f", "score": "4"}', 4, "f"),
        ('{"feedback": null, "score": 2}', 2, "None"),
        ('{"feedback": "f", "score": "4.5"}', 1, 'Invalid JSON from judge: {"feedback": "f", "score": "4.5"}'),
        ('{"feedback": "f", "score": null}', 1, 'Invalid JSON from judge: {"feedback": "f", "score": null}'),
        ('{"score": 3}', 1, 'Invalid JSON from judge: {"score": 3}'),
        ('{"feedback": "f", "score": 3} or {"score": 4}', 1, 'Invalid JSON from judge: {"feedback": "f", "score": 3} or {"score": 4}'),
        ("{'feedback': 'f', 'score': 3}", 1, "Invalid JSON from judge: {'feedback': 'f', 'score': 3}"),
        ("nothing like it", 1, "No JSON object found in response: nothing like it"),
        ("x" * 300, 1, "No JSON object found in response: " + "x" * 200),
    ],
)
def test_judge(value, raw, score, feedback):
    got = value(replies.parse_judge("t"), t=raw)
    assert (got["judge_score"], got["judge_feedback"]) == (score, feedback)


def test_check(value):
    def check(raw, finish="stop"):
        return value(replies.parse_check("t", "f"), t=raw, f=finish).asDict()

    full = '{"coherent": true, "coherence": 8, "coherence_evidence": "e", "missing": ["a", null, 3, "d"], "notes": "n"}'
    assert check(full) == {
        "coherent": True, "coherence": 5, "coherence_evidence": "e", "missing": ["a", "None", "3"], "notes": "n",
    }
    short = check('{"coherent": false, "coherence": 2, "missing": null, "notes": null}')
    assert (short["coherent"], short["coherence_evidence"], short["missing"], short["notes"]) == (False, "", [], "None")
    assert check('{"coherence": 2, "notes": "n"}')["notes"].startswith("Invalid JSON from model: ")
    cut = check('{"coherent": true, "coher', "length")
    assert (cut["coherent"], cut["coherence"], cut["missing"]) == (False, 0, [])
    assert cut["notes"] == 'Reply cut at the 2048 token ceiling, not a formatting error: {"coherent": true, "coher'
    assert check("words", "stop")["notes"] == "No JSON object in reply: words"


@pytest.mark.parametrize(
    ("stored", "items"), [(None, []), ("", []), ("[1, \"b\"]", ["1", "b"]), ('{"a": 1}', []), ("[1,", []), ("null", [])]
)
def test_json_list(spark, stored, items):
    df = spark.createDataFrame([(stored,)], "t string")
    assert df.select(replies.json_list("t")).first()[0] == items


def verdict(coherent, coherence, evidence, missing, notes):
    return dict(coherent=coherent, coherence=coherence, coherence_evidence=evidence, missing=missing, notes=notes)


def test_merge_and_records(spark):
    pieces = [
        ("u1", 2, verdict(True, 2, "  ", ["q2", "q3"], " second ")),
        ("u1", 1, verdict(True, 5, "fine", [], "first")),
        ("u1", 3, verdict(False, 2, "proof", ["q4", "q5"], "third")),
        ("u2", 1, verdict(True, 4, "", ["once"], " as written ")),
        ("u3", 1, verdict(True, 5, "", [], "a")),
        ("u3", 2, verdict(True, 5, "", [], "b")),
    ]
    df = spark.createDataFrame(pieces, f"url string, n int, verdict {replies.CHECK_TYPE}")
    merged = selfcheck.merge_verdicts(df, ["url"])
    rows = {r["url"]: r for r in merged.collect()}
    assert rows["u1"]["coherent"] is False and rows["u1"]["coherence"] == 2
    assert rows["u1"]["coherence_evidence"] == "proof"
    assert rows["u1"]["claimed_missing"] == ["q2", "q3", "q4"]
    assert rows["u1"]["notes"] == "[pezzo 2/3] second [pezzo 3/3] third"
    assert rows["u2"]["notes"] == " as written "
    assert rows["u3"]["notes"] == "Nessun problema trovato in 2 pezzi."

    said = "twelve monkeys sat on the fence and said nothing"
    texts = spark.createDataFrame(
        [("u1", f"<p>{said}</p>", "kept"), ("u2", "<p>once</p>", "x" * 50), ("u3", "", "")],
        "url string, html_text string, parsed_text string",
    )
    claimed = merged.withColumn("claimed_missing", F.when(F.col("url") == "u1", F.array(F.lit(said))).otherwise(F.col("claimed_missing")))
    records = {r["url"]: r for r in selfcheck.check_records(claimed, texts, ["url"]).collect()}
    assert records["u1"]["omissions"] == 1 and records["u1"]["complete"] is False
    assert records["u2"]["omissions"] == 0 and records["u2"]["grounded"] == 0.0
    assert records["u3"]["grounded"] is None and records["u3"]["coherent_by_score"] is True


def test_quotes_the_limit_cuts_off_are_counted(spark):
    quotes = [f"quote {i}" for i in range(7)]
    raw = '{"coherent": true, "coherence": 4, "missing": %s, "notes": "n"}' % str(quotes).replace("'", '"')
    df = spark.createDataFrame([("u", 1, raw, "stop"), ("u", 2, raw, "stop"), ("v", 1, "nothing", "stop")], "url string, n int, raw string, finish_reason string")
    rows = {r["url"]: r for r in selfcheck.merge_verdicts(selfcheck.with_verdicts(df), ["url"]).collect()}
    assert rows["u"]["claimed_total"] == 14 and rows["u"]["claimed_missing"] == quotes[:3]
    assert rows["v"]["claimed_total"] == 0
