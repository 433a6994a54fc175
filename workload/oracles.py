"""The same questions in plain SQL for the checking engine, over the same tables."""

from __future__ import annotations

from gleaner.operators.rules import ENCYCLOPEDIA, FINANCE, NEWS, SPORTS, RulePack

from . import fixtures as fx
from .queries import SMALL_BUDGET, SWEEP

METRICS = ("precision_val", "recall_val", "f1", "cosine", "jaccard", "excess_ratio")


# Patterns of this file's own, for what the given pages and the derived texts hold.
NETLOC = r"://([^/?#]*)"
UNSEEN = r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->|<[a-z/!][^>]*>"
PLAIN_MARKDOWN = (
    (r"</?[A-Za-z][^<>]*>", ""),
    (r"!\[[^\]]*\]\([^()]*(?:\([^()]*\)[^()]*)*\)", ""),
    (r"\[([^\[\]]*)\]\([^()]*(?:\([^()]*\)[^()]*)*\)", "$1"),
    (r"(?m)^ {0,3}#{1,6}[ \t]+(.*?)[ \t]*$", "$1"),
    (r"(?m)^ {0,3}(?:(?:-[ \t]*){3,}|(?:\*[ \t]*){3,}|(?:_[ \t]*){3,})$", ""),
    (r"(?m)^ {0,3}>(?: ?>)* ?", ""),
    (r"(?m)^[ \t]*(?:[-*+]|\d{1,9}[.)])[ \t]+", ""),
    (r"`([^`\n]+)`", "$1"),
    *((r"\*([^\s*](?:[^*\n]*[^\s*])?)\*", "$1"),) * 3,
    (r"[ \t]+", " "),
    (r"\n{2,}", "\n"),
)


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sub(expr: str, pattern: str, replacement: str) -> str:
    """regexp_replace everywhere, with this engine's group references."""
    out = replacement.replace("$1", r"\1").replace("$2", r"\2")
    return f"regexp_replace({expr}, {lit(pattern)}, {lit(out)}, 'g')"


def strip(expr: str) -> str:
    return sub(expr, r"^\s+|\s+$", "")


REFERENCES = (("quot", '"'), ("copy", "©"), ("middot", "·"), ("lt", "<"), ("gt", ">"), ("amp", "&"))


def decode(expr: str) -> str:
    """The references the given pages hold, with and without their semicolon."""
    for name, char in REFERENCES:
        expr = sub(expr, f"&{name}([^;]|$)", char + "$1")
    for name, char in REFERENCES:
        expr = f"replace({expr}, {lit(f'&{name};')}, {lit(char)})"
    return expr


def markdown_of(html: str) -> str:
    """The markdown of the given pages, whose few elements plain replacements tell apart."""
    steps = (
        (r"(?s)<script\b.*?</script>", ""),
        (r"(?s)<style\b.*?</style>", ""),
        (r"(?s)<!--.*?-->", ""),
        (r"\s+", " "),
        (r'<li><a href="([^"]*)">([^<]*)</a></li>', "\n* [$2]($1)\n"),
        (r"<h1>", "\n\n# "),
        (r"</?(?:nav|div|article|p|footer|h1|body|html|ul)(?: [^>]*)?>", "\n\n"),
        (r"</?b>", "**"),
        (r"<br>", "\n"),
        (r"<[a-zA-Z/][^>]*>", ""),
    )
    expr = f"regexp_extract({html}, '(?s)<body>(.*)', 1)"
    for pattern, replacement in steps:
        expr = sub(expr, pattern, replacement)
    expr = decode(expr)
    for pattern, replacement in (
        (r"(?m)^[ \t]+|[ \t]+$", ""),
        (r"[ \t]+", " "),
        (r"(?m)^[*`~ ]+$", ""),
        # Items of one list stand on consecutive lines; every second seam per pass.
        (r"(\* \[[^\n]*)\n\n+(\* \[)", "$1\n$2"),
        (r"(\* \[[^\n]*)\n\n+(\* \[)", "$1\n$2"),
        (r"\n{3,}", "\n\n"),
    ):
        expr = sub(expr, pattern, replacement)
    return f"trim({expr}, chr(10) || ' ')"


def strip_markdown(expr: str) -> str:
    for pattern, replacement in PLAIN_MARKDOWN:
        expr = sub(expr, pattern, replacement)
    return strip(decode(expr))


def normalise(expr: str) -> str:
    return "trim(lower(" + sub(sub(expr, r"\[\p{Nd}+\]", " "), r"[^\p{L}\p{N}]+", " ") + "))"


def visible(expr: str) -> str:
    return normalise(decode(sub(expr, UNSEEN, " ")))


def plain(expr: str) -> str:
    return "trim(" + sub(sub(expr, "(?s)<[^>]*>", " "), "[ \\t\\n]+", " ") + ")"


def r6(expr: str, name: str, places: int = 6) -> str:
    return f"round({expr}, {places}) AS {name}"


ARTICLE = plain("regexp_extract(html_text, '(?s)<article>(.*?)</article>', 1)")
_body = "regexp_extract(html_text, '(?s)<body>(.*)</body>', 1)"
for _p in (r"(?s)<script\b.*?</script>", r"(?s)<style\b.*?</style>", r"(?s)<nav\b.*?</nav>", r"(?s)<!--.*?-->"):
    _body = sub(_body, _p, "")
BODY = plain(_body)
TOKENS = "CAST(floor(length(html_text) / 3.0) AS BIGINT)"

_run_rows = ", ".join(
    "(" + ", ".join("NULL" if v is None else lit(v) if isinstance(v, str) else str(v) for v in r) + ")"
    for r in fx.RUNS
)
_ok = ", ".join(f"CASE WHEN status = 'ok' THEN {e} END AS {n}" for n, e in fx.OK_COLUMNS.items())
_checks = ", ".join(f"CASE WHEN checked THEN {e} END AS {n}" for n, e in fx.CHECK_COLUMNS.items())
_eval_metrics = {
    "precision_val": "CAST(page_id % 991 AS DOUBLE) / 997",
    "recall_val": "CAST(page_id % 983 AS DOUBLE) / 991",
    "f1": "CAST(page_id % 977 AS DOUBLE) / 983",
    "cosine": "CAST(page_id % 971 AS DOUBLE) / 977",
    "jaccard": "CAST(page_id % 967 AS DOUBLE) / 971",
    "excess_ratio": "CAST(page_id % 953 AS DOUBLE) / 967",
}

CTES = {
    "p": (
        (),
        f"SELECT page_id, url, regexp_extract(url, {lit(NETLOC)}, 1) AS domain, "
        f"{strip('regexp_extract(html, ' + lit('(?is)<title[^>]*>(.*?)</title>') + ', 1)')} AS title, "
        "html AS html_text FROM pages",
    ),
    "pairs": (
        ("p",),
        f"""SELECT page_id, url, domain, CASE WHEN body = '' THEN '' ELSE concat('# ', title, chr(10), chr(10), body,
 chr(10), chr(10), '* [', domain, '](', url, ') **', page_id, '** `1,', th, '`') END AS parsed_text,
 concat(article, chr(10), domain, ' (1.', th, '%) ', page_id) AS gold_text
 FROM (SELECT *, {BODY} AS body, {ARTICLE} AS article, lpad(CAST(page_id % 1000 AS VARCHAR), 3, '0') AS th FROM p)""",
    ),
    "gold": (("p",), f"SELECT url, {ARTICLE} AS gold_text FROM p WHERE {fx.COMPLETE}"),
    "evals": (
        ("p",),
        "SELECT url, "
        + ", ".join(f"CASE WHEN {fx.SECURE} THEN {e} END AS {n}" for n, e in _eval_metrics.items())
        + f", CASE WHEN {fx.DOT_COM} THEN CAST(1 + page_id % 5 AS INT) END AS judge_score "
        f"FROM p WHERE {fx.SECURE} OR {fx.DOT_COM}",
    ),
    "runs": (
        (),
        "SELECT run_id, label, model_name, provider, condition_name, budget_tokens, "
        "CAST(eur_per_usd AS DOUBLE) AS eur_per_usd, CAST(measured_cost_eur AS DOUBLE) AS measured_cost_eur, created_at "
        f"FROM (VALUES {_run_rows}) AS t(run_id, label, model_name, provider, condition_name, "
        "budget_tokens, eur_per_usd, measured_cost_eur, created_at)",
    ),
    "res": (
        ("p", "runs"),
        f"""SELECT *, {_checks} FROM (SELECT *, {_ok} FROM (SELECT *, {fx.STATUS} AS status, {fx.HASH} AS h FROM
 (SELECT p.page_id, p.url, p.domain, {TOKENS} AS input_tokens, r.run_id, r.label, r.budget_tokens
  FROM p CROSS JOIN (SELECT * FROM runs WHERE run_id < 4) r
  WHERE NOT (r.run_id = 1 AND p.url LIKE '%?%'))))""",
    ),
    "three": ((), "SELECT page_id, url, n FROM pages CROSS JOIN (VALUES (1), (2), (3)) AS v(n)"),
    "judge": (("three",), f"SELECT page_id, url, n, {fx.JUDGE_REPLY} AS raw FROM three"),
    "judged": (
        ("judge",),
        """SELECT page_id, url, n, raw, CASE WHEN js = '' THEN 1 WHEN ok THEN
 greatest(1, least(5, CAST(json_extract_string(js, '$.score') AS INT))) ELSE 1 END AS judge_score,
 CASE WHEN js = '' THEN concat('No JSON object found in response: ', raw[:200])
  WHEN ok THEN json_extract_string(js, '$.feedback') ELSE concat('Invalid JSON from judge: ', js[:200]) END AS judge_feedback
 FROM (SELECT *, js <> '' AND json_extract_string(nullif(js, ''), '$.score') IS NOT NULL AS ok FROM
 (SELECT *, regexp_extract(regexp_replace(raw, '(?is)<think>.*?</think>', '', 'g'), '(?s)\\{.*\\}') AS js FROM judge))""",
    ),
    "checks": (
        ("three",),
        f"""SELECT page_id, url, n, {fx.CHECK_REPLY} AS raw,
 CASE WHEN (page_id + n) % 2 = 0 THEN 'length' ELSE 'stop' END AS finish_reason FROM three""",
    ),
    "verdicts": (
        ("checks",),
        """SELECT page_id, url, n,
 CASE WHEN js IS NULL THEN false ELSE json_extract_string(js, '$.coherent') = 'true' END AS coherent,
 CASE WHEN js IS NULL THEN 0 ELSE greatest(0, least(5, CAST(json_extract_string(js, '$.coherence') AS INT))) END AS coherence,
 CASE WHEN js IS NULL THEN '' ELSE json_extract_string(js, '$.coherence_evidence') END AS coherence_evidence,
 CASE WHEN js IS NULL THEN CAST([] AS VARCHAR[]) ELSE CAST(json_extract(js, '$.missing') AS VARCHAR[]) END AS missing,
 CASE WHEN js IS NULL AND finish_reason = 'length' THEN
   concat('Reply cut at the 2048 token ceiling, not a formatting error: ', raw[:200])
  WHEN js IS NULL THEN concat('No JSON object in reply: ', raw[:200]) ELSE json_extract_string(js, '$.notes') END AS notes
 FROM (SELECT *, nullif(regexp_extract(regexp_replace(raw, '(?is)<think>.*?</think>', '', 'g'), '(?s)\\{.*\\}'), '') AS js FROM checks)""",
    ),
    "merged": (
        ("verdicts",),
        """SELECT page_id, url, bool_and(coherent) AS coherent, min(coherence) AS coherence,
 coalesce(first(coherence_evidence ORDER BY n) FILTER (WHERE coherence = worst AND trim(coherence_evidence) <> ''), '') AS coherence_evidence,
 flatten(list(missing ORDER BY n)) AS claimed_missing,
 coalesce(string_agg(concat('[pezzo ', n, '/3] ', trim(notes)), ' ' ORDER BY n)
  FILTER (WHERE NOT coherent OR coherence < 5 OR len(missing) > 0), 'Nessun problema trovato in 3 pezzi.') AS notes,
 3 AS check_fragments
 FROM (SELECT *, min(coherence) OVER (PARTITION BY page_id) AS worst FROM verdicts) GROUP BY page_id, url""",
    ),
    "stored": (("p",), f"SELECT url, domain, title, html_text FROM p WHERE {fx.SECURE}"),
    "incoming": (
        ("p",),
        f"SELECT url, domain, 'new' AS title, concat('<title> new </title>', html_text) AS html_text FROM p WHERE {fx.DOT_COM}",
    ),
    "plain": (
        ("pairs",),
        f"SELECT page_id, domain, {strip_markdown('parsed_text')} AS p, {strip_markdown('gold_text')} AS g FROM pairs",
    ),
}


def _compare(expr: str) -> str:
    return f"lower(translate({expr}, '‘’“”–—', '''''\"\"--'))"


def _canonical(w: str) -> str:
    core = f"trim({w}, '()€£')"
    number = r"[+\-]?\d[\d.,]*\d%?|[+\-]?\d%?"
    return (
        f"CASE WHEN regexp_full_match({core}, {lit(number)}) "
        f"THEN translate(rtrim({core}, '%'), '.,', '') ELSE {w} END"
    )


def _scores(source: str, key: str) -> dict[str, tuple[tuple[str, ...], str]]:
    """Score CTEs over ``source(key, p, g)`` of plain texts."""
    def set_of(side: str) -> str:
        return (
            f"SELECT DISTINCT {key}, {_canonical('w')} AS w FROM (SELECT {key}, "
            f"unnest(string_split(replace({_compare(side)}, chr(10), ' '), ' ')) AS w FROM {source}) WHERE w <> ''"
        )

    def bag_of(side: str) -> str:
        return (
            f"SELECT {key}, w, count(*) AS n FROM (SELECT {key}, "
            f"unnest(regexp_split_to_array({_compare(side)}, '\\s+')) AS w FROM {source}) WHERE w <> '' GROUP BY ALL"
        )

    return {
        "pset": ((source,), set_of("p")),
        "gset": ((source,), set_of("g")),
        "pbag": ((source,), bag_of("p")),
        "gbag": ((source,), bag_of("g")),
        "tl": (
            ("pset", "gset"),
            f"""SELECT *, CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END AS f1 FROM
 (SELECT {key}, e AS extracted_count, s AS sample_count, i AS intersection_count,
  CASE WHEN e > 0 THEN i / e ELSE 0 END AS pr, CASE WHEN s > 0 THEN i / s ELSE 0 END AS re FROM
 (SELECT x.{key}, coalesce(a.n, 0) AS e, coalesce(b.n, 0) AS s, coalesce(c.n, 0) AS i FROM {source} x
  LEFT JOIN (SELECT {key}, count(*) AS n FROM pset GROUP BY 1) a USING ({key})
  LEFT JOIN (SELECT {key}, count(*) AS n FROM gset GROUP BY 1) b USING ({key})
  LEFT JOIN (SELECT {key}, count(*) AS n FROM pset JOIN gset USING ({key}, w) GROUP BY 1) c USING ({key})))""",
        ),
        "sim": (
            ("pbag", "gbag"),
            f"""SELECT x.{key}, CASE WHEN a.t > 0 AND b.t > 0 THEN coalesce(c.dot, 0) / (sqrt(a.sq) * sqrt(b.sq)) ELSE 0 END AS cosine,
 CASE WHEN a.t > 0 AND b.t > 0 THEN coalesce(c.k, 0) / (a.k + b.k - coalesce(c.k, 0)) ELSE 0 END AS jaccard,
 CASE WHEN a.t > 0 AND b.t > 0 THEN 1 - coalesce(c.m, 0) / a.t ELSE 0 END AS excess_ratio FROM {source} x
 LEFT JOIN (SELECT {key}, sum(n) AS t, sum(n * n) AS sq, count(*) AS k FROM pbag GROUP BY 1) a USING ({key})
 LEFT JOIN (SELECT {key}, sum(n) AS t, sum(n * n) AS sq, count(*) AS k FROM gbag GROUP BY 1) b USING ({key})
 LEFT JOIN (SELECT {key}, sum(pbag.n * gbag.n) AS dot, sum(least(pbag.n, gbag.n)) AS m, count(*) AS k
  FROM pbag JOIN gbag USING ({key}, w) GROUP BY 1) c USING ({key})""",
        ),
    }


def sql(body: str, *needs: str, extra: dict | None = None) -> str:
    """``body`` with the CTEs it names, in order of need."""
    known = {**CTES, **(extra or {})}
    order: list[str] = []

    def add(name: str) -> None:
        if name in order or name not in known:
            return
        for need in known[name][0]:
            add(need)
        order.append(name)

    for name in needs:
        add(name)
    ctes = ", ".join(f"{n} AS ({known[n][1]})" for n in order)
    return f"WITH {ctes} {body}" if ctes else body


PAIR_SCORES = _scores("plain", "page_id")
TOKEN_COLUMNS = (
    f"{r6('pr', 'precision')}, {r6('re', 'recall')}, {r6('f1', 'f1')}, extracted_count, sample_count, intersection_count"
)
BAG_COLUMNS = ", ".join(r6(c, c) for c in ("cosine", "jaccard", "excess_ratio"))


# --- cutting of pages ----------------------------------------------------------

# Told again as recursive SQL: tags with their text, blocks of neighbours up to a width, long text cut to a
# step, blocks packed greedily, and the same again for the even share. Every limit from the even share to the
# budget is tried for the evenest one.
STEP = """CASE WHEN (hi - lo) // 3 <= budget THEN hi - lo
 WHEN (hi - lo) * budget // ((hi - lo) // 3) // 3 <= budget THEN (hi - lo) * budget // ((hi - lo) // 3)
 ELSE (hi - lo) * budget // ((hi - lo) // 3) * budget // ((hi - lo) * budget // ((hi - lo) // 3) // 3) - 1 END"""
CUTS = r"""
WITH RECURSIVE b(budget) AS (VALUES {budgets}),
big AS (SELECT page_id, html, budget, length(html) AS chars FROM pages, b WHERE length(html) // 3 > budget),
tok AS (SELECT page_id, unnest(t) AS tok, unnest(range(1, len(t) + 1)) AS i FROM
 (SELECT page_id, regexp_extract_all(html, '^[^<]+|<[^<]*') AS t FROM pages)),
span AS (SELECT page_id, i, CAST(sum(length(tok)) OVER w - length(tok) AS BIGINT) AS lo, CAST(sum(length(tok)) OVER w AS BIGINT) AS hi,
 coalesce(regexp_matches(lead(tok) OVER w, '^<[^/]'), true) AS closes FROM tok WINDOW w AS (PARTITION BY page_id ORDER BY i)),
coarse_w AS (SELECT page_id, budget, greatest(1, CAST(floor(budget * 3.0 / 32) AS BIGINT)) AS w FROM big),
coarse_to AS (SELECT c.page_id, budget, s.lo, coalesce(max(e.hi) FILTER (WHERE e.closes AND e.hi <= s.lo + w), any_value(s.hi)) AS hi
 FROM coarse_w c JOIN span s USING (page_id) JOIN span e ON e.page_id = s.page_id AND e.lo >= s.lo AND (e.hi <= s.lo + w OR e.i = s.i) GROUP BY 1, 2, 3),
coarse AS (
 SELECT page_id, budget, 1 AS k, lo, hi FROM coarse_to WHERE lo = 0
 UNION ALL SELECT c.page_id, c.budget, k + 1, t.lo, t.hi FROM coarse c JOIN coarse_to t
  ON t.page_id = c.page_id AND t.budget = c.budget AND t.lo = c.hi),
coarse_cut AS (SELECT page_id, budget, row_number() OVER (PARTITION BY page_id, budget ORDER BY lo, at_) AS k, at_ AS lo, least(hi, at_ + step) AS hi
 FROM (SELECT *, unnest(range(lo, hi, step)) AS at_ FROM (SELECT *, {step} AS step FROM coarse))),
coarse_n AS (
 SELECT page_id, budget, k, (hi - lo) // 3 + 1 AS filled, 1 AS groups FROM coarse_cut WHERE k = 1
 UNION ALL SELECT c.page_id, c.budget, c.k, CASE WHEN n.filled + (hi - lo) // 3 + 1 > c.budget THEN (hi - lo) // 3 + 1
  ELSE n.filled + (hi - lo) // 3 + 1 END, n.groups + CAST(n.filled + (hi - lo) // 3 + 1 > c.budget AS INT)
  FROM coarse_n n JOIN coarse_cut c ON c.page_id = n.page_id AND c.budget = n.budget AND c.k = n.k + 1),
fewest AS (SELECT page_id, budget, max(groups) AS fewest FROM coarse_n GROUP BY 1, 2),
share AS (SELECT page_id, budget, fewest, CAST(ceil(sum((hi - lo) // 3 + 1) / fewest) AS BIGINT) AS share
 FROM coarse_cut JOIN fewest USING (page_id, budget) GROUP BY 1, 2, 3),
fine_w AS (SELECT page_id, budget, greatest(1, CAST(floor(share * 3.0 / 32) AS BIGINT)) AS w FROM share),
fine_to AS (SELECT c.page_id, budget, s.lo, coalesce(max(e.hi) FILTER (WHERE e.closes AND e.hi <= s.lo + w), any_value(s.hi)) AS hi
 FROM fine_w c JOIN span s USING (page_id) JOIN span e ON e.page_id = s.page_id AND e.lo >= s.lo AND (e.hi <= s.lo + w OR e.i = s.i) GROUP BY 1, 2, 3),
fine AS (
 SELECT page_id, budget, 1 AS k, lo, hi FROM fine_to WHERE lo = 0
 UNION ALL SELECT c.page_id, c.budget, k + 1, t.lo, t.hi FROM fine c JOIN fine_to t
  ON t.page_id = c.page_id AND t.budget = c.budget AND t.lo = c.hi),
fine_cut AS (SELECT page_id, budget, row_number() OVER (PARTITION BY page_id, budget ORDER BY lo, at_) AS k, at_ AS lo, least(hi, at_ + step) AS hi
 FROM (SELECT *, unnest(range(lo, hi, step)) AS at_ FROM (SELECT *, {step} AS step FROM fine))),
fine_n AS (
 SELECT page_id, budget, k, (hi - lo) // 3 + 1 AS filled, 1 AS groups FROM fine_cut WHERE k = 1
 UNION ALL SELECT c.page_id, c.budget, c.k, CASE WHEN n.filled + (hi - lo) // 3 + 1 > c.budget THEN (hi - lo) // 3 + 1
  ELSE n.filled + (hi - lo) // 3 + 1 END, n.groups + CAST(n.filled + (hi - lo) // 3 + 1 > c.budget AS INT)
  FROM fine_n n JOIN fine_cut c ON c.page_id = n.page_id AND c.budget = n.budget AND c.k = n.k + 1),
chosen AS (SELECT page_id, budget, fewest, share, max(groups) AS fine_groups FROM fine_n JOIN share USING (page_id, budget) GROUP BY 1, 2, 3, 4),
piece AS (SELECT page_id, budget, k, lo, hi, (hi - lo) // 3 + 1 AS size, least(fewest, fine_groups) AS needed FROM chosen
 JOIN (SELECT *, true AS is_fine FROM fine_cut UNION ALL SELECT *, false FROM coarse_cut) USING (page_id, budget)
 WHERE is_fine = (fewest > 1 AND fine_groups <= fewest))"""
GROUPED = r""",
tried AS (SELECT page_id, budget, needed, unnest(range(CASE WHEN needed > 1 THEN CAST(ceil(sum(size) / needed) AS BIGINT) ELSE budget END, budget + 1)) AS lim
 FROM piece GROUP BY 1, 2, 3),
pack AS (
 SELECT page_id, lim, k, size AS filled, 1 AS g FROM tried JOIN piece USING (page_id, budget) WHERE k = 1
 UNION ALL SELECT n.page_id, n.lim, p.k, CASE WHEN n.filled + size > n.lim THEN size ELSE n.filled + size END,
  n.g + CAST(n.filled + size > n.lim AS INT) FROM pack n JOIN piece p ON p.page_id = n.page_id AND p.k = n.k + 1),
evenest AS (SELECT page_id, min(lim) AS lim FROM (SELECT page_id, lim, max(g) AS g FROM pack GROUP BY 1, 2)
 JOIN tried USING (page_id, lim) WHERE g <= needed GROUP BY 1),
grouped AS (SELECT page_id, g, min(lo) AS lo, max(hi) AS hi FROM pack JOIN evenest USING (page_id, lim)
 JOIN piece USING (page_id, k) GROUP BY 1, 2)
"""


def cuts(*budgets: int) -> str:
    listed = ", ".join(f"(CAST({b} AS BIGINT))" for b in budgets)
    return CUTS.replace("{budgets}", listed).replace("{step}", STEP)


# --- rule packs --------------------------------------------------------------


def _any(expr: str, patterns) -> str:
    tests = [f"regexp_matches({expr}, {lit(p)})" for p in patterns]
    return "(" + " OR ".join(tests) + ")" if tests else "false"


PLAYER_LINKS = "concat(url, CASE WHEN page_id % 2 = 0 THEN '/player/stats/' ELSE '' END)"


def line_rules(pack: RulePack, link: str = PLAYER_LINKS, where: str = "true") -> str:
    heading = "CASE WHEN line LIKE '#%' THEN lower(" + strip("ltrim(line, '#')") + ") END"
    low = "lower(" + strip("line") + ")"

    def among(expr: str, values) -> str:
        return f"coalesce({expr} IN ({', '.join(lit(v) for v in values)}), false)" if values else "false"

    def prefixed(expr: str, values) -> str:
        return "(" + " OR ".join(f"coalesce(starts_with({expr}, {lit(v)}), false)" for v in values) + ")" if values else "false"

    heads = prefixed(heading, pack.stop_headings) if pack.stop_headings_by_prefix else among(heading, pack.stop_headings)
    stop = f"({_any('line', pack.stop_patterns)} OR {heads} OR {among(low, pack.stop_lines)})"
    markdown = "markdown"
    for pattern, replacement in pack.rewrites:
        markdown = sub(markdown, pattern, replacement)
    line = "raw" if not pack.trim_line_ends else sub("raw", r"\s+$", "")
    rewritten = "line"
    for pattern, replacement in pack.line_rewrites:
        rewritten = sub(rewritten, pattern, replacement)
    drop = (
        f"({among(heading, pack.drop_headings)} OR {among(low, pack.drop_lines)} OR "
        f"{prefixed(low, pack.drop_prefixes)} OR {_any(strip('line'), pack.drop_stripped)})"
    )
    start = f"regexp_matches(line, {lit(pack.start_pattern)})" if pack.start_pattern else "false"
    is_stats = f"contains(link, {lit(pack.start_in_url)})" if pack.start_in_url else "false"
    cells = "[line]"
    if pack.one_cell_per_line:
        text = strip("line")
        inner = f"list_filter(list_transform(string_split(trim({text}, '|'), '|'), lambda c: trim(c)), lambda c: c <> '')"
        cells = f"CASE WHEN {text} LIKE '|%|%' THEN {inner} ELSE [line] END"
    blank = "regexp_matches(line, '^\\s*$')"
    cut = f"regexp_matches(line, {lit(pack.cut_from_last)})" if pack.cut_from_last else "false"
    emitted = lit(pack.start_emits)
    body = f"""SELECT x.page_id, coalesce(y.parsed_text, '') AS parsed_text FROM src x LEFT JOIN
 (SELECT page_id, string_agg(line, chr(10) ORDER BY i, j) AS parsed_text FROM trimmed GROUP BY 1) y USING (page_id)"""
    extra = {
        "src": (
            ("p",),
            f"SELECT page_id, {link} AS link, {fx.LINES_MARKDOWN} AS markdown "
            f"FROM (SELECT *, {ARTICLE} AS article FROM p) WHERE {where}",
        ),
        "ls": (
            ("src",),
            f"SELECT page_id, link, {line} AS line, i FROM (SELECT page_id, link, unnest(string_split({markdown}, chr(10))) AS raw, "
            f"unnest(range(len(string_split({markdown}, chr(10))))) AS i FROM src)",
        ),
        "started": (("ls",), f"SELECT page_id, min(i) FILTER (WHERE {start}) AS s, any_value({is_stats}) AS stats FROM ls GROUP BY 1"),
        "after": (
            ("started",),
            "SELECT ls.*, s FROM ls JOIN started USING (page_id) WHERE NOT stats OR i > s",
        ),
        "stopped": (("after",), f"SELECT page_id, min(i) AS e FROM after WHERE {stop} GROUP BY 1"),
        "kept": (
            ("stopped",),
            f"SELECT page_id, {rewritten} AS line, i FROM after LEFT JOIN stopped USING (page_id) "
            f"WHERE i < coalesce(e, 1000000000) AND NOT {_any('line', pack.drop_first)} AND NOT {drop}",
        ),
        "split": (
            ("kept", "started"),
            f"""SELECT page_id, unnest({cells}) AS line, i, unnest(range(len({cells}))) AS j FROM kept WHERE NOT {_any('line', pack.drop_last)}
 UNION ALL SELECT page_id, {emitted}, -1, 0 FROM started WHERE stats AND s IS NOT NULL""",
        ),
        "filled": (("split",), f"SELECT page_id, max((i, j)) AS z FROM split WHERE NOT {blank} GROUP BY 1"),
        "full": (("filled",), "SELECT split.* FROM split JOIN filled USING (page_id) WHERE (i, j) <= z"),
        "cuts": (("full",), f"SELECT page_id, max((i, j)) AS c FROM full WHERE {cut} GROUP BY 1"),
        "short": (("cuts",), "SELECT full.*, c FROM full LEFT JOIN cuts USING (page_id) WHERE c IS NULL OR (i, j) < c"),
        "ends": (("short",), f"SELECT page_id, max((i, j)) AS z FROM short WHERE NOT {blank} GROUP BY 1"),
        "trimmed": (("ends",), "SELECT short.* FROM short JOIN ends USING (page_id) WHERE (i, j) <= z"),
    }
    extra = {n.replace("full", "upto"): (tuple(d.replace("full", "upto") for d in need), text.replace("full.", "upto.").replace("FROM full ", "FROM upto ")) for n, (need, text) in extra.items()}
    return sql(body, "src", "trimmed", extra=extra)


# --- oracles -----------------------------------------------------------------

DOMAIN_FIGURES = """count(*) FILTER (WHERE status = 'ok') AS ok, count(*) FILTER (WHERE status = 'too_long') AS too_long,
 count(*) FILTER (WHERE status = 'error') AS errors, round(avg(precision_val), 6) AS precision, round(avg(recall_val), 6) AS recall,
 round(avg(f1), 6) AS f1, round(avg(cosine), 6) AS cosine, round(avg(excess_ratio), 6) AS excess_ratio, round(avg(seconds), 6) AS seconds"""

ELECTRIC = "(1.52 / 3600 / 1000 * 0.236)"
HARDWARE = "(1250.74 / (8.0 * 365 * 24 * 3600))"
HEADLINES = f"""SELECT runs.*, coalesce(t.ok, 0) AS ok, coalesce(t.too_long, 0) AS too_long, coalesce(t.errors, 0) AS errors,
 coalesce(t.empty, 0) AS empty, t.precision, t.recall, t.f1, t.excess_ratio, t.seconds, t.cpu_seconds, t.wall_seconds,
 coalesce(t.input_tokens, 0) AS input_tokens, coalesce(t.skipped_tokens, 0) AS skipped_tokens, coalesce(t.calls, 0) AS calls,
 coalesce(t.chunked_pages, 0) AS chunked_pages, coalesce(t.page_cost, measured_cost_eur) AS cost_eur,
 t.page_cost IS NULL AND measured_cost_eur IS NOT NULL AS cost_is_aggregate,
 CASE WHEN lower(trim(provider)) <> 'openrouter' AND t.wall_seconds > 0 THEN t.wall_seconds END AS local_seconds
 FROM runs LEFT JOIN (SELECT run_id, count(*) FILTER (WHERE status = 'ok') AS ok, count(*) FILTER (WHERE status = 'too_long') AS too_long,
  count(*) FILTER (WHERE status = 'error') AS errors, count(*) FILTER (WHERE status = 'empty') AS empty,
  avg(precision_val) AS precision, avg(recall_val) AS recall, avg(f1) AS f1, avg(excess_ratio) AS excess_ratio, avg(seconds) AS seconds,
  sum(cpu_seconds) AS cpu_seconds, sum(seconds) AS wall_seconds,
  CAST(sum(input_tokens) FILTER (WHERE status = 'ok') AS BIGINT) AS input_tokens,
  CAST(sum(input_tokens) FILTER (WHERE status <> 'ok') AS BIGINT) AS skipped_tokens,
  CAST(sum(coalesce(fragments, 1)) FILTER (WHERE status = 'ok') AS BIGINT) AS calls,
  count(*) FILTER (WHERE status = 'ok' AND fragments > 1) AS chunked_pages, sum(cost_eur) AS page_cost
  FROM res GROUP BY run_id) t USING (run_id)"""
CTES["heads"] = (("runs", "res"), HEADLINES)
CHECKED = "FROM res WHERE check_coherent IS NOT NULL"


def _pearson(x: str) -> str:
    x = f"CAST({x} AS DOUBLE)"
    both = f"FILTER (WHERE {x} IS NOT NULL AND f1 IS NOT NULL)"
    return f"covar_pop({x}, f1) {both} / nullif(stddev_pop({x}) {both} * stddev_pop(f1) {both}, 0)"


def _compare_runs(how: str) -> str:
    pairs_of = {"status": "status", "f1": "f1", "precision_val": "precision", "recall_val": "recall", "input_tokens": "tokens", "seconds": "seconds"}

    def shown(col: str, side: str) -> str:
        value = f"{side[0]}.{col}"
        return f"{value if col in ('status', 'input_tokens') else f'round({value}, 6)'} AS {side}_{pairs_of[col]}"

    columns = ", ".join(shown(c, s) for c in pairs_of for s in ("left", "right"))
    return sql(
        f"SELECT coalesce(l.url, r.url) AS url, coalesce(l.domain, r.domain) AS domain, {columns} "
        f"FROM (SELECT * FROM res WHERE run_id = 1) l {how} JOIN (SELECT * FROM res WHERE run_id = 2) r ON l.url = r.url",
        "res",
    )


def _visible_quotes() -> dict:
    invented = "this sentence was surely never written on any page"
    side = "trim(regexp_extract(html_text, '(?s)<div class=\"ad\">(.*?)</div>', 1))"
    anchored = (
        "(contains({hay}, q) OR (len(string_split(q, ' ')) >= 8 AND len(list_filter(range(1, len(string_split(q, ' ')) - 6), "
        "lambda i: contains({hay}, array_to_string(string_split(q, ' ')[i:i + 7], ' ')))) > 0))"
    )
    return {
        "quoted": (
            ("p",),
            f"""SELECT page_id, {visible('html_text')} AS page, {normalise('article')} AS extraction, article, unnest([
 array_to_string(string_split(article, ' ')[11:20], ' '), {side}, {lit(invented)}, {lit(invented[:20])}]) AS quote
 FROM (SELECT *, {ARTICLE} AS article FROM p)""",
        ),
        "found": (
            ("quoted",),
            f"""SELECT page_id, quote, {anchored.format(hay='page')} AS in_page, {anchored.format(hay='extraction')} AS in_extraction
 FROM (SELECT page_id, page, extraction, {strip('quote')} AS quote, {normalise('quote')} AS q FROM quoted) WHERE quote <> ''""",
        ),
        "quotes": (
            ("found",),
            """SELECT page_id, quote, CASE WHEN length(quote) < 25 THEN 'troppo corta' WHEN NOT in_page THEN 'inventata'
 WHEN in_extraction THEN 'presente' ELSE 'confermata' END AS verdict, in_page, in_extraction FROM found""",
        ),
    }


def _doc_scores() -> str:
    extra = {
        "docs": (
            (),
            f"SELECT doc_id, {strip_markdown('text')} AS p, {strip_markdown("replace(text, 'en', 'in')")} AS g FROM documents",
        ),
        **_scores("docs", "doc_id"),
    }
    return sql(
        f"SELECT doc_id, {TOKEN_COLUMNS}, {BAG_COLUMNS} FROM tl JOIN sim USING (doc_id)", "tl", "sim", extra=extra
    )


def oracles() -> dict[str, str]:
    size = "md5(html_text) AS html"
    out: dict[str, str] = {}

    out["token_level_eval"] = sql(f"SELECT page_id, {TOKEN_COLUMNS} FROM tl", "tl", extra=PAIR_SCORES)
    out["similarity_eval"] = sql(f"SELECT page_id, {BAG_COLUMNS} FROM sim", "sim", extra=PAIR_SCORES)
    out["domain_eval"] = sql(
        f"""SELECT domain, count(*) AS pages, {r6('avg(pr)', 'precision')}, {r6('avg(re)', 'recall')}, {r6('avg(f1)', 'f1')},
 {r6('avg(cosine)', 'cosine')}, {r6('avg(jaccard)', 'jaccard')}, {r6('avg(excess_ratio)', 'excess_ratio')}
 FROM plain JOIN tl USING (page_id) JOIN sim USING (page_id) GROUP BY domain""",
        "tl", "sim", extra=PAIR_SCORES,
    )
    out["document_pair_scores"] = _doc_scores()
    out["conversation_bag_sizes"] = f"""WITH t AS (SELECT conv_id, turn, text FROM conversations)
 SELECT conv_id, turn, len(list_distinct(list_transform(list_filter(string_split(replace({_compare('text')}, chr(10), ' '), ' '),
 lambda w: w <> ''), lambda w: {_canonical('w')}))) AS set_size,
 len(list_filter(regexp_split_to_array({_compare('text')}, '\\s+'), lambda w: w <> '')) AS bag_size FROM t"""
    out["word_counts"] = sql(
        """SELECT page_id, w AS word, coalesce(pbag.n, 0) AS parsed_count, coalesce(gbag.n, 0) AS gold_count
 FROM pbag FULL JOIN gbag USING (page_id, w)""", "pbag", "gbag", extra=PAIR_SCORES,
    )
    out["judge_previews"] = sql("SELECT page_id, p[:1000] AS parsed_preview, g[:1000] AS gold_preview FROM plain", "plain")
    out["plain_text"] = sql("SELECT page_id, p AS plain FROM plain", "plain")
    gold_scores = {
        "golden": (
            ("pairs", "gold"),
            f"SELECT page_id, {strip_markdown('parsed_text')} AS p, {strip_markdown('gold.gold_text')} AS g FROM pairs JOIN gold USING (url)",
        ),
        **_scores("golden", "page_id"),
    }
    out["scores_where_gold"] = sql(
        f"SELECT page_id, {r6('pr', 'precision')}, {r6('re', 'recall')}, {r6('f1', 'f1')} FROM p LEFT JOIN tl USING (page_id)",
        "p", "tl", extra=gold_scores,
    )
    extracted = {
        "md": (("p",), f"SELECT page_id, url, domain, {markdown_of('html_text')} AS md FROM p"),
        "golden": (
            ("md", "gold"),
            f"SELECT page_id, url, domain, {strip_markdown('md')} AS p, {strip_markdown('gold_text')} AS g FROM md JOIN gold USING (url)",
        ),
        **_scores("golden", "page_id"),
    }
    out["text_constructs"] = sql(
        """SELECT page_id, concat(t, ' <b>', t, '</b> **x** &amp; ', t, ' and short h1 h2 ', t, ' c a b c d e f e d c b a *g* ''’✓') AS plain,
 regexp_replace(concat(lower(t), ' k q ', lower(t), ' e f h'), ' +', ' ', 'g') AS visible
 FROM (SELECT page_id, regexp_replace(trim(regexp_replace(title, '[^A-Za-z ]', '', 'g')), ' +', ' ', 'g') AS t FROM p)""", "p",
    )
    bare = sub("md", r"[^\p{L}\p{N}]+", " ")
    out["wrapped_markdown"] = sql(
        f"SELECT page_id, concat_ws(' ', 'ahead', 'before', nullif(trim({bare}), ''), 'behind', 'a', 'b') AS words FROM md", "md", extra=extracted
    )
    out["html_markdown"] = sql("SELECT page_id, md AS markdown FROM md", "md", extra=extracted)
    out["full_gold_eval"] = sql(
        f"""SELECT domain, count(*) AS pages, {r6('avg(pr)', 'precision')}, {r6('avg(re)', 'recall')}, {r6('avg(f1)', 'f1')},
 {r6('avg(cosine)', 'cosine')}, {r6('avg(jaccard)', 'jaccard')}, {r6('avg(excess_ratio)', 'excess_ratio')}
 FROM golden JOIN tl USING (page_id) JOIN sim USING (page_id) GROUP BY domain""",
        "tl", "sim", extra=extracted,
    )
    fresh = dict(zip(METRICS, ("pr", "re", "t.f1", "s.cosine", "s.jaccard", "s.excess_ratio")))
    out["missing_scores_filled"] = sql(
        "SELECT coalesce(e.url, n.url) AS url, "
        + ", ".join(f"round(coalesce(e.{m}, n.{m}), 6) AS {m}" for m in METRICS)
        + ", judge_score FROM evals e FULL JOIN (SELECT golden.url, "
        + ", ".join(f"{v} AS {m}" for m, v in fresh.items())
        + " FROM golden JOIN tl t USING (page_id) JOIN sim s USING (page_id)) n ON e.url = n.url",
        "evals", "tl", "sim", extra=extracted,
    )
    out["parse_fetched"] = sql(
        f"""SELECT url, domain, NOT ok AS fallback_used, {strip_markdown('md')} AS cleaned_text FROM
 (SELECT md.*, {fx.COMPLETE} AS ok FROM md JOIN p USING (page_id)) WHERE (ok OR {fx.SECURE})
 AND domain IN (SELECT domain FROM p JOIN gold USING (url))""",
        "md", "gold", extra=extracted,
    )
    out["run_records"] = sql(
        f"""SELECT 7 AS run_id, url, domain, status, input_tokens, html_kb, CASE WHEN status = 'ok' THEN length(parsed_text) END AS chars,
 CASE WHEN status = 'ok' THEN round(f1, 6) END AS f1, CASE WHEN status = 'ok' THEN extracted_count END AS extracted_count,
 CASE WHEN status = 'ok' THEN sample_count END AS sample_count FROM
 (SELECT p.page_id, p.url, p.domain, {TOKENS} AS input_tokens, CAST(round_even(length(html_text) / 1024, 0) AS BIGINT) AS html_kb, parsed_text,
  CASE WHEN p.{fx.DOT_COM} AND NOT p.{fx.SECURE} THEN 'error' WHEN parsed_text = '' THEN 'empty' ELSE 'ok' END AS status
  FROM p JOIN pairs USING (page_id)) JOIN tl USING (page_id)""",
        "pairs", "tl", extra=PAIR_SCORES,
    )

    window = "array_to_string(string_split(q, ' ')[i:i + 7], ' ')"
    page = visible(
        "concat('<html><head><title>', source, '</title><script>var a = ''', lang, ''';</script></head><body><p>', text, '</p></body></html>')"
    )
    out["grounding"] = f"""WITH d AS (SELECT doc_id, concat(text, chr(10), 'this closing line was certainly never part of the document') AS md,
 {page} AS page FROM documents),
 l AS (SELECT doc_id, page, {normalise('line')} AS q FROM (SELECT doc_id, page, unnest(string_split(md, chr(10))) AS line FROM d)
  WHERE length({strip('line')}) >= 40),
 a AS (SELECT doc_id, contains(page, q) OR (len(string_split(q, ' ')) >= 8 AND
  len(list_filter(range(1, len(string_split(q, ' ')) - 6), lambda i: contains(page, {window}))) > 0) AS ok FROM l)
 SELECT doc_id, round(s, 6) AS grounded FROM documents LEFT JOIN (SELECT doc_id, avg(CAST(ok AS INT)) AS s FROM a GROUP BY 1) USING (doc_id)"""
    out["visible_text"] = sql(f"SELECT page_id, {visible('html_text')} AS visible FROM p", "p")
    quotes = _visible_quotes()
    out["quote_verdicts"] = sql("SELECT * FROM quotes", "quotes", extra=quotes)
    out["confirmed_omissions"] = sql(
        """SELECT page_id, count(*) FILTER (WHERE verdict = 'confermata') AS omissions,
 count(*) FILTER (WHERE verdict = 'confermata') = 0 AS complete FROM quotes GROUP BY 1""",
        "quotes", extra=quotes,
    )

    out["gold_by_domain"] = sql(
        """SELECT domain, a.n AS pages, b.n AS gold_pages FROM (SELECT domain, count(*) AS n FROM p GROUP BY 1) a LEFT JOIN
 (SELECT domain, count(*) AS n FROM p JOIN gold USING (url) GROUP BY 1) b USING (domain)""", "gold",
    )
    out["gold_domains"] = sql("SELECT DISTINCT domain FROM p JOIN gold USING (url)", "gold")
    out["gold_entries"] = sql("SELECT url, domain, title, gold_text FROM p JOIN gold USING (url)", "gold")
    out["missing_evals"] = sql(
        "SELECT gold.url FROM gold LEFT JOIN evals USING (url) WHERE precision_val IS NULL", "gold", "evals"
    )
    means = ", ".join(r6(f"avg({m})", m) for m in METRICS)
    out["domain_quality"] = sql(
        f"SELECT domain, {means} FROM evals JOIN p USING (url) WHERE precision_val IS NOT NULL GROUP BY 1", "evals"
    )
    judge = ", ".join(r6(f"coalesce(avg({m}), 0)", m) for m in ("judge_score", "f1", "cosine"))
    judge_sql = f"SELECT domain, {judge} FROM evals JOIN p USING (url) WHERE precision_val IS NOT NULL OR judge_score IS NOT NULL GROUP BY 1"
    out["domain_judge"] = sql(judge_sql, "evals")
    out["domain_judge_without_scores"] = sql(
        "SELECT DISTINCT domain, 0.0::DOUBLE AS judge_score, 0.0::DOUBLE AS f1, 0.0::DOUBLE AS cosine FROM p JOIN gold USING (url)", "gold"
    )
    out["domain_dashboard"] = sql(
        f"""SELECT g.domain, g.n AS gold_pages, w.n AS pages, {', '.join('q.' + m for m in METRICS)}, j.judge_score FROM
 (SELECT domain, count(*) AS n FROM p JOIN gold USING (url) GROUP BY 1) g
 LEFT JOIN (SELECT domain, count(*) AS n FROM p GROUP BY 1) w USING (domain)
 LEFT JOIN (SELECT domain, {means} FROM evals JOIN p USING (url) WHERE precision_val IS NOT NULL GROUP BY 1) q USING (domain)
 LEFT JOIN ({judge_sql}) j USING (domain)""", "gold", "evals",
    )
    lean = "html_text"
    for tag in ("script", "style", "noscript"):
        lean = sub(lean, rf"(?is)<{tag}\b.*?</{tag}>", " ")
    lean = sub(lean, r"(?s)<!--.*?-->", " ")
    out["corpus_listing"] = sql(
        f"""SELECT *, input_tokens <= 1000 AS fits, lean_tokens <= 1000 AS lean_fits,
 row_number() OVER (PARTITION BY domain ORDER BY url) - 1 AS page_index FROM
 (SELECT url, domain, round(length(html_text) / 1024, 6) AS html_kb, {TOKENS} AS input_tokens,
  CAST(floor(length({lean}) / 3.0) AS BIGINT) AS lean_tokens FROM p)""", "p",
    )
    out["code_free_size"] = sql(f"SELECT page_id, length({lean}) AS lean_chars FROM p", "p")

    doubles = ("precision", "recall", "f1", "excess_ratio", "seconds", "cpu_seconds", "wall_seconds", "cost_eur")
    counters = ("ok", "too_long", "errors", "empty", "input_tokens", "skipped_tokens", "calls", "chunked_pages")
    out["run_headline"] = sql(
        f"""SELECT run_id, label, model_name, provider, condition_name, budget_tokens, eur_per_usd, created_at, {', '.join(counters)},
 {', '.join(r6(d, d, 4) for d in doubles)}, cost_is_aggregate,
 round(local_seconds * ({ELECTRIC} + {HARDWARE}) * 1e6, 4) AS local_cost_eur,
 round(local_seconds * {ELECTRIC} * 1e6, 4) AS local_cost_electricity_eur,
 round(local_seconds * {HARDWARE} * 1e6, 4) AS local_cost_hardware_eur FROM heads""", "heads",
    )
    out["run_by_domain"] = sql(f"SELECT run_id, domain, {DOMAIN_FIGURES} FROM res GROUP BY ALL", "res")
    out["run_rollup"] = sql(
        f"""SELECT run_id, domain, {DOMAIN_FIGURES}, count(*) FILTER (WHERE status = 'empty') AS empty, grouping(domain) = 1 AS is_total
 FROM res GROUP BY GROUPING SETS ((run_id, domain), (run_id))""", "res",
    )
    out["run_compare"] = _compare_runs("LEFT")
    out["run_compare_full"] = _compare_runs("FULL")
    side = "SELECT domain, count(*) FILTER (WHERE status = 'ok') AS ok, count(*) FILTER (WHERE status = 'too_long') AS too_long, avg(f1) AS f1, avg(seconds) AS seconds FROM res WHERE run_id = {} GROUP BY 1"
    out["run_compare_domains"] = sql(
        f"""SELECT domain, l.ok AS left_ok, l.too_long AS left_too_long, round(l.f1, 6) AS left_f1, round(l.seconds, 6) AS left_seconds,
 r.ok AS right_ok, r.too_long AS right_too_long, round(r.f1, 6) AS right_f1, round(r.seconds, 6) AS right_seconds,
 round(CASE WHEN abs(r.f1 - l.f1) < 0.001 THEN 0 ELSE r.f1 - l.f1 END, 6) AS f1_difference
 FROM ({side.format(2)}) l LEFT JOIN ({side.format(3)}) r USING (domain)""", "res",
    )
    out["compare_axes"] = sql(
        f"""SELECT round(l.f1, 4) AS left_f1, round(r.f1, 4) AS right_f1,
 round(CASE WHEN abs(r.f1 - l.f1) < 0.001 THEN 0 ELSE r.f1 - l.f1 END, 4) AS f1_difference, l.ok AS left_ok, r.ok AS right_ok,
 r.ok - l.ok AS ok_difference, round(l.ok / (l.ok + l.too_long + l.errors), 4) AS left_coverage,
 round(r.ok / (r.ok + r.too_long + r.errors), 4) AS right_coverage, round(l.seconds / r.seconds, 4) AS speed_ratio,
 l.calls AS left_calls, r.calls AS right_calls, r.calls - l.calls AS call_difference, false AS both_remote,
 round(r.cost_eur, 4) AS right_price_eur, round(r.ok / r.cost_eur, 4) AS right_pages_per_eur,
 round(r.cost_eur / r.calls, 4) AS right_eur_per_call, CAST(NULL AS DOUBLE) AS left_eur_per_call
 FROM (SELECT * FROM heads WHERE run_id = 1) l, (SELECT * FROM heads WHERE run_id = 3) r""", "heads",
    )
    out["default_pair"] = sql("SELECT max(run_id) AS left_id, min(run_id) AS right_id FROM res", "res")
    out["latest_checked_run"] = sql(
        "SELECT run_id, label FROM runs WHERE run_id = (SELECT max(run_id) FROM res WHERE check_coherent IS NOT NULL)", "res"
    )
    newest = {
        "newest": (
            ("res", "runs"),
            """SELECT * FROM (SELECT res.url, res.run_id, runs.label AS run_label, model_name, created_at AS run_date, parsed_text, f1, seconds,
 cost_eur, fragments, grounded, row_number() OVER (PARTITION BY url ORDER BY created_at DESC, res.run_id DESC) AS k
 FROM res JOIN runs ON res.run_id = runs.run_id WHERE status = 'ok' AND parsed_text IS NOT NULL AND provider <> 'locale') WHERE k = 1""",
        )
    }
    out["latest_extraction"] = sql(
        """SELECT url, run_id, run_label, model_name, run_date, parsed_text, round(f1, 6) AS f1, round(seconds, 6) AS seconds,
 round(cost_eur, 6) AS cost_eur, fragments, round(grounded, 6) AS grounded FROM newest""", "newest", extra=newest,
    )
    out["stored_or_live"] = sql(
        """SELECT page_id, coalesce(newest.parsed_text, gold_text) AS parsed_text, CASE WHEN newest.url IS NOT NULL THEN 'stored'
 WHEN gold_text IS NOT NULL THEN 'live' END AS source, run_label, model_name, run_date, round(seconds, 6) AS seconds,
 round(cost_eur, 6) AS cost_eur, fragments, round(grounded, 6) AS grounded FROM p LEFT JOIN newest USING (url) LEFT JOIN gold USING (url)""",
        "newest", "gold", extra=newest,
    )
    out["worst_pages"] = sql(
        "SELECT url, round(f1, 6) AS f1 FROM res WHERE run_id = 2 AND status = 'ok' ORDER BY res.f1, url LIMIT 5", "res"
    )
    out["run_pages"] = sql(
        "SELECT url, status, round(f1, 6) AS f1, round(seconds, 6) AS seconds FROM res WHERE run_id = 3", "res"
    )
    out["page_of_run"] = sql(
        """SELECT url, runs.label, model_name, condition_name, status, round(f1, 6) AS f1 FROM res JOIN runs USING (run_id)
 WHERE run_id = 3 AND url = 'https://m.ththth.example.net/en/25#top'""", "res",
    )
    text_side = "SELECT url, runs.label, condition_name, status, f1, parsed_text FROM res JOIN runs USING (run_id) WHERE run_id = {}"
    out["compare_texts"] = sql(
        f"""SELECT coalesce(l.url, r.url) AS url, l.label AS left_label, l.condition_name AS left_condition, l.status AS left_status,
 round(l.f1, 6) AS left_f1, CASE WHEN l.url IS NOT NULL THEN coalesce(l.parsed_text, '') END AS left_text,
 r.label AS right_label, r.condition_name AS right_condition, r.status AS right_status, round(r.f1, 6) AS right_f1,
 CASE WHEN r.url IS NOT NULL THEN coalesce(r.parsed_text, '') END AS right_text
 FROM ({text_side.format(1)}) l FULL JOIN ({text_side.format(2)}) r ON l.url = r.url""", "res",
    )
    out["run_costs"] = sql(
        """SELECT run_id, round(spent, 6) AS spent_eur, calls, round(spent / calls, 6) AS eur_per_call FROM
 (SELECT run_id, coalesce(sum(cost_eur), 0) AS spent, CAST(sum(CASE WHEN status = 'ok' THEN coalesce(fragments, 1) END) AS BIGINT) AS calls
  FROM res GROUP BY 1) WHERE spent <> 0""", "res",
    )

    out["self_check_summary"] = sql(
        f"""SELECT run_id, count(*) AS checked, count(*) FILTER (WHERE check_coherent) AS passed,
 count(*) FILTER (WHERE NOT check_coherent) AS failed, {r6('avg(f1) FILTER (WHERE check_coherent)', 'f1_passed')},
 {r6('avg(f1) FILTER (WHERE NOT check_coherent)', 'f1_failed')}, {r6('avg(f1)', 'f1_all')},
 count(*) FILTER (WHERE NOT check_complete) AS not_complete, count(*) FILTER (WHERE NOT check_coherent) AS not_coherent,
 {r6('sum(check_cost_eur)', 'cost_eur')}, {r6('avg(check_coherence)', 'coherence_mean')}, count(check_coherence) AS scored,
 CAST(sum(check_omissions) AS BIGINT) AS omissions {CHECKED} GROUP BY 1""", "res",
    )
    out["self_check_corr"] = sql(
        f"""SELECT run_id, {r6(_pearson('check_coherent'), 'r_check')}, {r6(_pearson('coalesce(check_complete, false)'), 'r_complete')},
 {r6(_pearson('grounded'), 'r_grounded')}, {r6(_pearson('check_coherence'), 'r_coherence')},
 {r6(_pearson('(check_coherence >= 3)'), 'r_coherence_cut')} {CHECKED} GROUP BY 1""", "res",
    )
    out["checked_pages"] = sql(
        f"SELECT url, round(f1, 6) AS f1, check_coherent, check_coherence {CHECKED} AND run_id = 2", "res"
    )
    out["quote_counts"] = sql(
        f"""SELECT run_id, coalesce(nullif({fx.VERDICT}, ''), 'sconosciuto') AS verdict, count(*) AS quotes FROM
 (SELECT run_id, h, unnest(range(1, 2 + CAST(h % 3 AS INT))) AS i {CHECKED}) GROUP BY ALL""", "res",
    )
    out["provider_share"] = sql(
        f"""SELECT *, count(*) OVER (PARTITION BY run_id) > 1 AS several_providers FROM
 (SELECT run_id, coalesce(nullif({fx.PROVIDER}, ''), '(non dichiarato)') AS provider, count(*) AS calls FROM
 (SELECT run_id, h, unnest(range(1, 1 + coalesce(fragments, 1))) AS i FROM res WHERE status = 'ok') GROUP BY ALL)""", "res",
    )
    out["coherence_hist"] = sql(
        f"SELECT run_id, check_coherence, count(*) AS pages, {r6('avg(f1)', 'f1')} {CHECKED} AND check_coherence IS NOT NULL GROUP BY 1, 2", "res"
    )
    out["verdict_disagreement"] = sql(
        f"SELECT run_id, url, round(f1, 6) AS f1, check_coherent, check_coherence {CHECKED} AND check_coherent <> (check_coherence >= 3)", "res"
    )
    has = "(coalesce(check_omissions, 0) > 0)"
    out["omission_effect"] = sql(
        f"""SELECT run_id, count(*) FILTER (WHERE {has}) AS pages_with, {r6(f'avg(f1) FILTER (WHERE {has})', 'f1_with')},
 {r6(f'avg(f1) FILTER (WHERE NOT {has})', 'f1_without')}, {r6(_pearson(has), 'r_omissions')} {CHECKED} GROUP BY 1""", "res",
    )
    out["grounding_split"] = sql(
        f"SELECT run_id, grounded < 0.6 AS below, count(*) AS pages, {r6('avg(f1)', 'f1')} {CHECKED} AND grounded IS NOT NULL GROUP BY 1, 2", "res"
    )

    out["judge_parse"] = sql("SELECT page_id, n, judge_score, judge_feedback FROM judged", "judged")
    out["judge_means"] = sql(
        "SELECT domain, round(avg(judge_score), 6) AS judge_score, count(*) AS replies FROM judged JOIN p USING (page_id) GROUP BY 1", "judged", "p"
    )
    thinkless = strip(sub("raw", "(?is)<think>.*?</think>", ""))
    fence = r"(?s)\A\s*```[a-zA-Z]*\s*\n(.*)\n\s*```\s*\z"
    cleaned = {
        "cleaned": (
            ("judge",),
            f"""SELECT *, CASE WHEN regexp_matches(t, {lit(fence)}) THEN {strip(f'regexp_extract(t, {lit(fence)}, 1)')} ELSE t END AS cleaned
 FROM (SELECT *, {thinkless} AS t FROM judge)""",
        )
    }
    out["clean_replies"] = sql("SELECT page_id, n, cleaned, page_id % 2 = 0 AS nothing FROM cleaned", "cleaned", extra=cleaned)
    out["cleaning_audit"] = sql(
        f"""SELECT domain, count(*) AS replies, count(*) FILTER (WHERE changed) AS changed,
 count(*) FILTER (WHERE changed AND starts_with(o, '```')) AS fenced, count(*) FILTER (WHERE changed AND contains(lower(raw), '<think>')) AS thought,
 CAST(coalesce(sum(length(o) - length(cleaned)) FILTER (WHERE changed), 0) AS BIGINT) AS removed_chars
 FROM (SELECT *, {strip('raw')} AS o, cleaned <> {strip('raw')} AS changed FROM cleaned) JOIN p USING (page_id) GROUP BY 1""",
        "cleaned", "p", extra=cleaned,
    )
    out["check_parse"] = sql(
        "SELECT page_id, n, coherent, coherence, coherence_evidence, array_to_string(missing, '|') AS missing, notes FROM verdicts", "verdicts"
    )
    out["merge_checks"] = sql(
        "SELECT page_id, coherent, coherence, coherence_evidence, array_to_string(claimed_missing, '|') AS claimed_missing, notes, len(claimed_missing) AS claimed_total, check_fragments FROM merged",
        "merged",
    )
    out["json_lists"] = sql(
        """SELECT page_id, n, CASE WHEN (page_id + n) % 4 = 3 THEN concat(url, '|b', n) ELSE '' END AS items FROM three""", "three"
    )
    call = "CASE (page_id + n) % 4 WHEN 0 THEN '' WHEN 1 THEN 'south' ELSE 'north' END"
    cost = "CAST((page_id * 13 + n * 7) % 101 AS DOUBLE) / 997"
    out["call_rollups"] = sql(
        f"""SELECT page_id, count(*) AS calls, {r6(f'sum({cost})', 'cost_usd')}, {r6(f'sum({cost}) * 0.92', 'cost_eur')},
 CAST(sum(length(url) + n) AS BIGINT) AS prompt_tokens, CAST(sum(page_id % 50 + n) AS BIGINT) AS completion_tokens,
 string_agg({call}, ',' ORDER BY n) AS providers, string_agg(concat('g', page_id, '-', n), ',' ORDER BY n) AS generation_ids,
 array_to_string(list_sort(list(DISTINCT nullif({call}, '')) FILTER (WHERE {call} <> '')), ',') AS providers_used FROM three GROUP BY 1""",
        "three",
    )

    for name, pack in (("encyclopedia", ENCYCLOPEDIA), ("news", NEWS), ("sports", SPORTS), ("finance", FINANCE)):
        out[f"line_rules_{name}"] = line_rules(pack)

    by_host = [
        f"SELECT page_id, parsed_text FROM ({line_rules(pack, 'url', f'page_id % 5 = {k}')})"
        for k, pack in enumerate((ENCYCLOPEDIA, NEWS, SPORTS, FINANCE))
    ]
    unknown = sql(
        f"SELECT page_id, {fx.LINES_MARKDOWN} AS parsed_text FROM (SELECT *, {ARTICLE} AS article FROM p) WHERE page_id % 5 = 4", "p"
    )
    out["line_rules_dispatch"] = " UNION ALL ".join([*by_host, f"SELECT page_id, parsed_text FROM ({unknown})"])

    out["fragment_integrity"] = sql(
        f"""SELECT url, true AS adds_up, 0 AS over_budget, {TOKENS} > {SMALL_BUDGET} AND
 trim(regexp_extract(html_text, '(?is)<title[^>]*>(.*?)</title>', 1)) = '' AS split_without_title, {TOKENS} > {SMALL_BUDGET} AS is_split FROM p""", "p",
    )
    out["budget_splits"] = sql(
        f"SELECT b AS budget_tokens, count(*) AS pages, count(*) FILTER (WHERE {TOKENS} > b) AS split_pages "
        f"FROM p CROSS JOIN (VALUES {', '.join(f'({b})' for b in SWEEP)}) AS v(b) GROUP BY 1", "p",
    )
    total = "CAST(floor(length(text) / 3.0) AS BIGINT)"
    out["text_cuts"] = f"""SELECT doc_id, CASE WHEN total <= 250 THEN 1 ELSE CAST(ceil(length(text) / step) AS INT) END AS pieces,
 true AS adds_up, false AS over_budget FROM (SELECT *, CASE WHEN floor(first / 3.0) > 250 THEN
  greatest(1, first * 250 // CAST(floor(first / 3.0) AS BIGINT) - 1) ELSE first END AS step FROM
 (SELECT doc_id, text, {total} AS total, length(text) * 250 // greatest({total}, 1) AS first FROM documents))"""
    stitched = {
        "w": (("p",), f"SELECT page_id, string_split({ARTICLE}, ' ') AS w FROM p"),
        "l": (("w",), "SELECT page_id, w, unnest(range((len(w) - 1) // 12 + 1)) AS i FROM w"),
        "numbered": (("l",), "SELECT page_id, i, concat('l', i, ' ', array_to_string(w[i * 12 + 1:i * 12 + 12], ' ')) AS line FROM l"),
        "groups": (("numbered",), "SELECT page_id, i // 3 AS k, string_agg(line, chr(10) ORDER BY i) AS piece FROM numbered GROUP BY 1, 2"),
    }
    out["stitch"] = sql(
        """SELECT page_id, string_agg(piece, chr(10) || chr(10) ORDER BY k) AS parsed_text, count(*) + 1 AS fragments, 1 AS empty_fragments,
 page_id % 9 = 0 AS truncated FROM groups GROUP BY 1""".replace("groups", "pieces"),
        "pieces", extra={("pieces" if k == "groups" else k): v for k, v in stitched.items()},
    )
    pieces = {("pieces" if k == "groups" else k): v for k, v in stitched.items()}
    pieces["texts"] = (
        ("pieces",),
        """SELECT page_id, string_agg(piece, chr(10) || chr(10) ORDER BY k) AS md, count(*) + 1 AS fragments FROM pieces GROUP BY 1""",
    )
    pieces["looked_up"] = (
        ("texts", "p"),
        f"""SELECT page_id, page, {normalise('line')} AS q FROM (SELECT page_id, {visible('html_text')} AS page,
 unnest(string_split(md, chr(10))) AS line FROM texts JOIN p USING (page_id)) WHERE length({strip('line')}) >= 40""",
    )
    pieces["shares"] = (
        ("looked_up",),
        f"""SELECT page_id, avg(CAST(contains(page, q) OR (len(string_split(q, ' ')) >= 8 AND
 len(list_filter(range(1, len(string_split(q, ' ')) - 6), lambda i: contains(page, {window}))) > 0) AS INT)) AS g FROM looked_up GROUP BY 1""",
    )
    out["truncated_pages"] = sql(
        """SELECT url, CASE WHEN page_id % 9 = 0 THEN 'error' ELSE 'ok' END AS status, CASE WHEN page_id % 9 <> 0 THEN length(md) END AS chars,
 fragments FROM texts JOIN p USING (page_id)""", "shares", "p", extra=pieces,
    )
    out["assembled_answers"] = sql(
        """SELECT url, fragments, 1 AS empty_fragments, round(g, 6) AS grounded FROM texts JOIN p USING (page_id) LEFT JOIN shares USING (page_id)""",
        "shares", extra=pieces,
    )
    one_line = "trim(" + sub(decode(sub("regexp_extract(html_text, '(?is)<title[^>]*>(.*?)</title>', 1)", "<[!?/A-Za-z][^>]*>?", " ")), r"\s+", " ") + ")"
    h1 = one_line.replace("<title[^>]*>(.*?)</title>", r"<h1\b[^>]*>(.*?)</h1>")
    out["page_fragments"] = cuts(SMALL_BUDGET) + GROUPED + f"""SELECT page_id, CAST(coalesce(g, 1) AS INT) AS n,
 CAST(count(*) OVER (PARTITION BY page_id) AS INT) AS fragments, {one_line} AS page_title, {h1} AS page_heading,
 coalesce(substring(html_text, lo + 1, hi - lo), html_text) AS fragment,
 coalesce(lo, 0) = 0 OR substring(html_text, lo + 1, 1) = '<' AS at_tag
FROM (SELECT page_id, html AS html_text FROM pages) LEFT JOIN grouped USING (page_id)"""
    out["budget_sweep"] = cuts(*SWEEP) + r"""SELECT CAST(budget AS INT) AS budget_tokens, count(*) AS pages, count(needed) AS split_pages,
 CAST(coalesce(sum(needed), 0) AS BIGINT) AS fragments_used, CAST(coalesce(sum(needed), 0) - count(needed) AS BIGINT) AS extra_calls
FROM (SELECT DISTINCT page_id, budget FROM pages, b) LEFT JOIN (SELECT DISTINCT page_id, budget, needed FROM piece WHERE needed > 1) USING (page_id, budget)
GROUP BY 1"""
    out["repeated_titles"] = sql(
        f"""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN concat('body of ', url) ELSE
 concat(CASE WHEN page_id % 3 = 1 THEN '## ' ELSE '# Other ' END, translate({one_line}, 'aeiou ', 'AEIOU	'), ' ', chr(10), chr(10), 'body of ', url) END AS kept FROM p""", "p",
    )
    out["page_budgets"] = f"""SELECT doc_id, 94883 AS fragment_budget,
 CAST(floor((128000 - 2500 - 2048 - {total}) / 1.15) AS BIGINT) AS check_budget FROM documents"""
    status = "CASE {long} WHEN " + f"{fx.DOT_COM} AND NOT {fx.SECURE} THEN 'error' WHEN {BODY} = '' THEN 'empty' ELSE 'ok' END"
    out["page_statuses"] = sql(
        f"""SELECT page_id, {TOKENS} AS input_tokens, CAST(round_even(length(html_text) / 1024, 0) AS BIGINT) AS html_kb,
 length(html_text) AS chars, {status.format(long=f"WHEN {TOKENS} > 1500 THEN 'too_long'")} AS status, {status.format(long='')} AS chunked_status FROM p""", "p",
    )
    out["url_parts"] = sql(
        f"""SELECT page_id, domain, lower(regexp_extract(upper(url), {lit(NETLOC)}, 1)) AS host, title, {one_line} AS context_title,
 {h1} AS context_heading FROM p""", "p",
    )

    absent = "SELECT * REPLACE (concat(html_text, ' copy 1') AS html_text) FROM incoming WHERE url NOT IN (SELECT url FROM stored)"
    sized = f"url, domain, title, {size}"
    out["insert_absent"] = sql(f"SELECT {sized} FROM (SELECT * FROM stored UNION ALL {absent})", "stored", "incoming")
    out["insert_entries"] = sql(
        f"""SELECT url, domain, title, md5(concat(html_text, CASE WHEN NOT {fx.SECURE} THEN ' copy 1' ELSE '' END)) AS html,
 concat({ARTICLE}, CASE WHEN NOT ({fx.SECURE} AND {fx.COMPLETE}) THEN ' copy 1' ELSE '' END) AS gold_text FROM p""", "p"
    )
    upserted = "(SELECT * FROM stored WHERE url NOT IN (SELECT url FROM incoming) UNION ALL SELECT * REPLACE (concat(html_text, ' copy 3') AS html_text) FROM incoming)"
    out["upsert_pages"] = sql(f"SELECT {sized} FROM {upserted}", "stored", "incoming")
    out["guarded_gold"] = sql(
        f"""SELECT url, gold_text, false AS rejected FROM gold WHERE {fx.SECURE} AND url NOT IN (SELECT url FROM incoming)
 UNION ALL SELECT url, concat('gold of ', url, ' copy ', k), url NOT IN (SELECT url FROM stored) FROM incoming, range(1, 4) AS r(k)
 WHERE k = 3 OR url NOT IN (SELECT url FROM stored)""", "gold", "stored", "incoming",
    )
    out["save_pages_with_gold"] = sql(
        f"""SELECT {sized}, gold_text FROM {upserted} LEFT JOIN (SELECT url, gold_text FROM gold WHERE {fx.SECURE} AND url NOT IN (SELECT url FROM incoming)
 UNION ALL SELECT url, concat('gold of ', url, ' copy 3') FROM incoming) USING (url)""", "gold", "stored", "incoming",
    )
    out["cascade_delete"] = sql(
        f"""SELECT url, 'pages' AS kept_in FROM p WHERE NOT {fx.DOT_COM} UNION ALL SELECT url, 'gold' FROM gold WHERE NOT {fx.DOT_COM}
 UNION ALL SELECT url, 'evaluations' FROM evals WHERE NOT {fx.DOT_COM} UNION ALL SELECT url, 'removed' FROM p WHERE {fx.DOT_COM}""", "gold", "evals",
    )
    out["delete_gold"] = sql(f"SELECT url FROM gold WHERE NOT {fx.DOT_COM}", "gold")
    out["upsert_metrics"] = sql(
        "SELECT coalesce(e.url, i.url) AS url, "
        + ", ".join(f"CASE WHEN i.url IS NOT NULL THEN 0.25 ELSE round({m}, 6) END AS {m}" for m in METRICS)
        + ", judge_score FROM evals e FULL JOIN incoming i ON e.url = i.url", "evals", "incoming",
    )
    out["upsert_judge"] = sql(
        "SELECT coalesce(e.url, g.url) AS url, " + ", ".join(f"round({m}, 6) AS {m}" for m in METRICS)
        + ", CASE WHEN g.url IS NOT NULL THEN 4 ELSE judge_score END AS judge_score FROM evals e FULL JOIN gold g ON e.url = g.url", "evals", "gold",
    )
    out["replace_run"] = sql(
        """SELECT run_id, label, url, status FROM res WHERE run_id <> 2 UNION ALL SELECT 20, 'model-a', url, status FROM res WHERE run_id = 3""", "res"
    )
    hit = f"(run_id = 2 AND {fx.SECURE} AND NOT {fx.DOT_COM} AND {fx.COMPLETE})"
    out["attach_checks"] = sql(
        f"""SELECT run_id, url, CASE WHEN {hit} THEN true ELSE check_complete END AS check_complete,
 CASE WHEN {hit} THEN false ELSE check_coherent END AS check_coherent, CASE WHEN {hit} THEN 1 ELSE check_coherence END AS check_coherence,
 CASE WHEN {hit} THEN 0 ELSE check_omissions END AS check_omissions, CASE WHEN {hit} THEN 0.125 ELSE round(check_cost_eur, 6) END AS check_cost_eur,
 CASE WHEN {hit} AND length(html_text) > 3000 THEN 0.75 ELSE round(grounded, 6) END AS grounded
 FROM (SELECT res.*, html_text FROM res JOIN p USING (url))""", "res",
    )
    out["unmatched_checks"] = sql(
        f"SELECT 2 AS run_id, concat(url, '#gone') AS url FROM p WHERE {fx.SECURE} AND {fx.DOT_COM} AND {fx.COMPLETE}", "p"
    )
    out["measured_costs"] = sql(
        """SELECT run_id, label, CASE WHEN run_id IN (2, 3) THEN n / 8 ELSE measured_cost_eur END AS measured_cost_eur
 FROM runs LEFT JOIN (SELECT run_id, count(*) AS n FROM res GROUP BY 1) USING (run_id)""", "res",
    )
    out["load_old_rows"] = sql(
        """SELECT run_id, url, status, round(f1, 6) AS f1, CASE WHEN run_id = 1 THEN round(cpu_seconds, 6) END AS cpu_seconds,
 CASE WHEN run_id = 1 THEN fragments END AS fragments FROM res""", "res",
    )
    out["evolved_columns"] = sql(
        "SELECT run_id, url, status, round(f1, 6) AS f1, CAST(NULL AS INT) AS check_coherence, CAST(NULL AS DOUBLE) AS grounded FROM res", "res"
    )
    out["seeded_pages"] = sql(
        f"SELECT {sized}, true AS was_empty FROM p UNION ALL SELECT {sized}, false FROM stored", "stored"
    )
    out["supported_pages"] = sql(
        "SELECT url, domain FROM p WHERE domain IN (SELECT domain FROM p JOIN gold USING (url) WHERE url LIKE '%example.net%')", "gold"
    )
    out["work_list"] = sql(
        "SELECT url, true AS exists FROM incoming UNION ALL SELECT concat(url, '#typo'), false FROM incoming", "incoming"
    )
    out["work_list_first"] = sql(
        f"SELECT url, domain FROM p WHERE {fx.DOT_COM} AND domain = 'blog.tiontion.example.com' ORDER BY domain, url LIMIT 3", "p"
    )
    out["resume"] = sql("SELECT url FROM res WHERE run_id = 2 AND status = 'error'", "res")
    out["checkable"] = sql("SELECT run_id, url FROM res WHERE status = 'ok' AND parsed_text <> ''", "res")
    out["fallback_copies"] = sql(
        f"""SELECT url, CASE WHEN NOT ok AND NOT {fx.SECURE} THEN NULL ELSE NOT ok END AS fallback_used,
 CASE WHEN NOT ok AND NOT {fx.SECURE} THEN NULL ELSE ok AND NOT {fx.SECURE} END AS first_seen,
 CASE WHEN ok THEN length(html_text) + 4 WHEN {fx.SECURE} THEN length(html_text) END AS chars FROM (SELECT *, {fx.COMPLETE} AS ok FROM p)""", "p",
    )
    out["seed_documents"] = sql(
        """SELECT replace(runs.label, '-', '_') AS slug, runs.label, provider, coalesce(n, 0) AS pages FROM runs LEFT JOIN
 (SELECT run_id, count(*) AS n FROM res GROUP BY 1) USING (run_id)""", "res",
    )
    out["check_records"] = sql(
        """SELECT url, coherent, coherence, coherence >= 3 AS coherent_by_score, CAST(missed AS INT) AS omissions, NOT missed AS complete,
 check_fragments FROM merged JOIN (SELECT url, page_id % 2 = 1 AND length(title) >= 25 AND NOT contains(title, '&') AS missed FROM p) USING (url)""",
        "merged", "p",
    )
    out["gold_files"] = sql(f"SELECT url, domain, title, md5(html_text) AS html, {ARTICLE} AS gold_text FROM p", "p")
    out["run_files"] = sql(
        """SELECT url, domain, status, round(f1, 6) AS f1, round(precision_val, 6) AS precision_val, parsed_text, 'm/a' AS model_name,
 1500 AS budget_tokens FROM res WHERE run_id = 2""", "res",
    )
    out["check_files"] = sql(
        f"""SELECT CASE WHEN {fx.DOT_COM} THEN concat(url, '#gone') ELSE url END AS url, CASE WHEN {fx.COMPLETE} THEN 'ok' ELSE 'error' END AS status,
 true AS complete, false AS coherent, 1 AS coherence, 0 AS omissions, 0.125 AS cost_eur, CASE WHEN length(html_text) > 3000 THEN 0.75 END AS grounded
 FROM p WHERE {fx.SECURE}""", "p",
    )
    out["seed_files"] = sql(
        f"""SELECT runs.label, url, status, round(f1, 6) AS f1, CASE WHEN status = 'ok' THEN
 array_to_string(list_transform(range(1, coalesce(fragments, 1) + 1), lambda i: {fx.PROVIDER}), ',') END AS providers
 FROM runs LEFT JOIN res USING (run_id)""", "runs", "res",
    )
    out["written_results"] = sql(
        f"""SELECT url, domain, status, round(f1, 6) AS f1 FROM res WHERE run_id = 2 AND status IN ('ok', 'too_long', 'empty') AND {fx.SECURE}""", "res"
    )
    out["known_records"] = sql("SELECT url, status FROM res WHERE run_id = 3", "res")
    out["newest_runs"] = sql("SELECT run_id, label FROM runs ORDER BY created_at DESC LIMIT 2", "runs")
    out["empty_domain"] = sql(
        """SELECT 'nowhere.example' AS domain, CAST(0 AS BIGINT) AS pages, CAST(NULL AS DOUBLE) AS judge_score UNION ALL
 SELECT 'all of org', count(*), round(avg(judge_score), 6) FROM gold JOIN p USING (url) JOIN judged USING (url) WHERE n = 1 AND domain LIKE '%.org'""",
        "gold", "judged",
    )
    out["gold_urls"] = sql("SELECT url FROM p JOIN gold USING (url)", "p", "gold")
    out["default_pairs"] = sql(
        """SELECT "left", "right", CAST(CASE WHEN "left" = 1 THEN 1 ELSE first END AS BIGINT) AS left_id,
 CAST(CASE "left" WHEN 1 THEN 2 WHEN 2 THEN 2 ELSE second END AS BIGINT) AS right_id
 FROM (VALUES (1, 2), (2, 9), (3, 9), (8, 9), (2, 2)) AS asked("left", "right"),
 (SELECT max(run_id) AS first, (SELECT max(run_id) FROM res WHERE run_id < (SELECT max(run_id) FROM res)) AS second FROM res)""", "res",
    )
    out["cleaned_examples"] = sql(
        f"""SELECT page_id, CAST(length(o) - length(cleaned) AS INT) AS removed_chars, o[:60] AS begins
 FROM (SELECT *, {strip('raw')} AS o FROM cleaned) WHERE cleaned <> o ORDER BY page_id LIMIT 20""",
        "cleaned", extra=cleaned,
    )
    out["claimed_quotes"] = sql("SELECT page_id, len(claimed_missing) AS claimed_total FROM merged", "merged")
    out["raw_reply_files"] = sql(
        """SELECT res.url AS url, CAST(k AS INT) AS n, CASE k WHEN 0 THEN judge.raw ELSE 'again' END AS raw
 FROM res JOIN judge USING (url), (VALUES (0), (1)) AS t(k) WHERE run_id = 2""", "res", "judge",
    )
    out["element_fragments"] = sql(
        f"""SELECT page_id, true AS adds_up, length(html_text) // 3 > {SMALL_BUDGET} AS is_split, 0 AS over_budget,
 CAST(len(list_filter(regexp_extract_all(html_text, '<p>[^<]*</p>'), lambda x: length(x) // 3 <= {SMALL_BUDGET})) AS INT) AS paragraphs,
 0 AS broken FROM p""", "p",
    )
    out["gold_array_file"] = sql(
        "SELECT url, domain, title, CAST(length(html_text) AS INT) AS html_chars, gold_text FROM p JOIN gold USING (url)", "p", "gold"
    )
    out["run_array_file"] = out["run_files"]
    out["stored_dashboard"] = out["domain_dashboard"]
    # Stored tables hold what the table steps give.
    for name in ("upsert_pages", "upsert_metrics", "guarded_gold", "replace_run"):
        out[f"stored_{name}"] = out[name]
    return out
