"""Language identification of web pages by weighing all that is known about a page.

Four witnesses are combined by Bayes' rule: the page's visible text, under a
naive Bayes model of byte trigrams per language; the language its markup
declares; and, as the prior, what other pages of its host say, smoothed towards
its parent domain, that towards its address suffix, and that towards all pages.
How far a declaration is to be believed, and every prior, are counts over all
pages, taken by grouped aggregation of what their texts alone suggest; a page's
own suggestion is left out of its prior.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.storage import durable, in_small_batches
from gleaner.llm.texts import byte_table, mixed, slices, split_words

DIMENSIONS = 1 << 14
# About so many labelled documents train the text model, chosen by a hash of their ids.
SAMPLE_ROWS = 20_000
SMOOTHING = 0.5
# A text counts as at most so many trigrams: neighbouring trigrams are no independent witnesses.
MOST_TRIGRAMS = 60.0
# How many pages an estimate one level up is worth.
PRIOR_PAGES = 10.0
LANGUAGE = "^[a-z]{2,3}$"

_LETTERS = byte_table((b for b in range(0x80) if not (0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A)), lower=True)
_TAG = re.compile(r"<!--(?:.*?-->|.*)|<(/?)([a-zA-Z][a-zA-Z0-9]*)[^<>]*>|<[!?/][^<>]*>", re.S)
_DECLARED = (
    re.compile(r"<html\b[^<>]*?\s(?:xml:)?lang\s*=\s*[\"']?\s*([A-Za-z]{2,3})(?![A-Za-z])", re.I),
    re.compile(r"<meta\b[^<>]*?content-language[^<>]*?\scontent\s*=\s*[\"']?\s*([A-Za-z]{2,3})(?![A-Za-z])", re.I),
)
_UNSEEN = {"script", "style", "noscript", "template"}


def visible(html: str) -> str:
    """The text outside tags, comments and elements that show nothing. One pass, linear in the page."""
    kept, at, hidden = [], 0, None
    for tag in _TAG.finditer(html):
        name = (tag.group(2) or "").lower()
        if hidden is None:
            kept.append(html[at : tag.start()])
            if name in _UNSEEN and not tag.group(1):
                hidden = name
        elif tag.group(1) and name == hidden:
            hidden = None
        at = tag.end()
    if hidden is None:
        kept.append(html[at:])
    return " ".join(kept)


def declared(html: str) -> str | None:
    """The language that the markup declares, in lower case."""
    for pattern in _DECLARED:
        found = pattern.search(html)
        if found:
            return found.group(1).lower()
    return None


# -- the text model --------------------------------------------------------------------------------


@dataclass
class TextModel:
    """``logs[language, trigram]`` and the languages, which are in order."""

    languages: list[str]
    logs: np.ndarray

    def log_likelihoods(self, column: pa.Array) -> np.ndarray:
        """One row per text; a text of many trigrams counts as ``MOST_TRIGRAMS`` of them."""
        trigram, owner = trigrams(column)
        texts = len(column)
        counts = np.bincount(owner, minlength=texts)
        out = np.empty((texts, len(self.languages)))
        for at in range(len(self.languages)):
            out[:, at] = np.bincount(owner, self.logs[at][trigram], minlength=texts)
        return out * np.minimum(1.0, MOST_TRIGRAMS / np.maximum(counts, 1))[:, None]


def trigrams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Every run of three bytes that touches a word, hashed, and the text it lies in.

    Words are runs of letters; one blank stands at either end of each.
    """
    words = split_words(column, _LETTERS)
    size = words.end - words.start
    begin = np.concatenate(([0], np.cumsum(size + 2)))
    spaced = np.full(begin[-1], 0x20, np.uint64)
    within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    spaced[np.repeat(begin[:-1] + 1, size) + within] = words.data[np.repeat(words.start, size) + within]
    if len(spaced) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    code = (spaced[:-2] << np.uint64(16)) | (spaced[1:-1] << np.uint64(8)) | spaced[2:]
    owner = np.repeat(words.text, size + 2)
    whole = (np.repeat(np.arange(len(size)), size + 2)[:-2] == np.repeat(np.arange(len(size)), size + 2)[2:])
    return (mixed(code[whole]) % np.uint64(DIMENSIONS)).astype(np.int64), owner[:-2][whole]


def fit_text_model(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample_rows: int = SAMPLE_ROWS
) -> TextModel:
    """Trigram frequencies of each language, from about ``sample_rows`` labelled documents.

    Labels that are no two- or three-letter code are left out, so the model is
    bounded by the number of such codes in use.
    """
    labelled = docs.select(
        F.xxhash64(F.col(doc_id), F.lit(9)).alias("_place"), F.lower(F.col(lang)).alias("_lang"), F.col(text).alias("_text")
    ).where(F.col("_lang").rlike(LANGUAGE))
    sizes = {r["_lang"]: r["n"] for r in labelled.groupBy("_lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    share = min(1.0, sample_rows / max(1, sum(sizes.values())))
    chosen = labelled.where(F.shiftrightunsigned("_place", 11) / F.lit(float(1 << 53)) < share).select("_lang", "_text")
    number = {name: i for i, name in enumerate(languages)}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(languages) * DIMENSIONS, np.int64)
        for batch in slices(batches, "_text"):
            trigram, owner = trigrams(batch.column("_text"))
            which = np.array([number[x] for x in batch.column("_lang").to_pylist()])
            if len(trigram):
                counts += np.bincount(which[owner] * DIMENSIONS + trigram, minlength=len(counts))
        cells = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(counts[cells])], ["cell", "n"])

    total = np.zeros((len(languages), DIMENSIONS))
    for row in in_small_batches(chosen).mapInArrow(run, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        total[divmod(row["cell"], DIMENSIONS)] = row["n"]
    total += SMOOTHING
    return TextModel(languages, np.log(total / total.sum(axis=1, keepdims=True)))


# -- evidence --------------------------------------------------------------------------------------


def host_of(url: Column) -> Column:
    """The host in lower case, without user, port and ``www.``; null where there is none."""
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.nullif(F.regexp_replace(host, r"^www\.|\.+$", ""), F.lit(""))


def parent_of(host: Column) -> Column:
    """The last two labels of a host, or three where the next to last is a short general one, as in co.uk."""
    general = r"((?:[^.]+\.)(?:co|com|org|net|ac|gov|edu)\.[a-z]{2})$"
    longer = F.regexp_extract(host, general, 1)
    return F.when(longer != "", longer).otherwise(F.substring_index(host, ".", -2))


def suffix_of(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def evidence(pages: DataFrame, model: TextModel, page_id: str, url: str, html: str) -> DataFrame:
    """Per page its id, address parts, declared language and the text's log likelihoods (``_logs``)."""

    held = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for batch in slices(batches, "_html"):
            sources = [h or "" for h in batch.column("_html").to_pylist()]
            logs = own.log_likelihoods(pa.array([visible(h) for h in sources], pa.string()))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("_id"), batch.column("_host"),
                    pa.array([declared(h) for h in sources], pa.string()),
                    pa.array(list(logs), pa.list_(pa.float64())),
                ],
                ["_id", "_host", "_declared", "_logs"],
            )

    kind = pages.schema[page_id].dataType.simpleString()
    rows = pages.select(F.col(page_id).alias("_id"), host_of(F.col(url)).alias("_host"), F.col(html).alias("_html"))
    found = in_small_batches(rows).mapInArrow(run, f"_id {kind}, _host string, _declared string, _logs array<double>")
    return found.withColumn("_parent", parent_of(F.col("_host"))).withColumn("_suffix", suffix_of(F.col("_host")))


def normalised(logs: Column) -> Column:
    """Probabilities that are in proportion to the exponentials of ``logs``."""
    shifted = F.transform(logs, lambda x: F.exp(x - F.array_max(logs)))
    return F.transform(shifted, lambda x: x / F.aggregate(shifted, F.lit(0.0), lambda a, b: a + b))


def summed(rows: DataFrame, keys: list[str], column: str, places: int, name: str) -> DataFrame:
    """The arrays in ``column`` added up place by place, per key."""
    sums = [F.sum(F.col(column)[i]).alias(f"_{i}") for i in range(places)]
    return rows.groupBy(*keys).agg(*sums).select(*keys, F.array(*[f"_{i}" for i in range(places)]).alias(name))


def identify(
    pages: DataFrame,
    model: TextModel,
    page_id: str = "page_id",
    url: str = "url",
    html: str = "html",
    prior_pages: float = PRIOR_PAGES,
) -> DataFrame:
    """One row per page: ``lang``, its ``confidence`` (the posterior), and what the witnesses say.

    ``text_lang`` is what the text alone suggests, null without letters;
    ``declared`` what the markup declares. A page without text is judged by the
    other witnesses, one without a host by the prior of all pages without one; a
    declaration that no language uses here is weighed like any other. Ties go to
    the first language in order. Repeated ids are rows of their own, other
    columns are not read. A model without languages gives null throughout.
    """
    places = len(model.languages)
    if not places:
        kind = pages.schema[page_id].dataType
        nothing = F.lit(None).cast("string")
        return pages.select(
            F.col(page_id).cast(kind), nothing.alias("lang"), F.lit(None).cast("double").alias("confidence"),
            nothing.alias("text_lang"), nothing.alias("declared"),
        )
    rows = durable(evidence(pages, model, page_id, url, html).withColumn("_own", normalised(F.col("_logs"))))

    # Counts by level; a page's text suggests a share of each language.
    hosts = durable(summed(rows, ["_host", "_parent", "_suffix"], "_own", places, "_in_host"))
    parents = summed(hosts, ["_parent", "_suffix"], "_in_host", places, "_in_parent")
    suffixes = summed(parents, ["_suffix"], "_in_parent", places, "_in_suffix")
    totals = summed(suffixes, [], "_in_suffix", places, "_in_all").first()["_in_all"]
    overall = np.array([x or 0.0 for x in totals]) if totals is not None else np.zeros(places)
    up = parents.select(F.col("_parent").alias("_p"), F.col("_suffix").alias("_s"), "_in_parent").join(
        suffixes.select(F.col("_suffix").alias("_t"), "_in_suffix"), F.col("_s").eqNullSafe(F.col("_t"))
    )
    levels = hosts.select(F.col("_host").alias("_h"), F.col("_parent").alias("_hp"), "_in_host").join(
        up, F.col("_hp").eqNullSafe(F.col("_p"))
    ).select("_h", "_in_host", "_in_parent", "_in_suffix")

    # How often each language's pages declare this, smoothed by how often anyone does.
    says = durable(summed(rows, ["_declared"], "_own", places, "_saying"))
    pages_in_all = float(overall.sum())
    said = says.select(
        F.col("_declared").alias("_d"),
        F.array(*[
            F.log(
                (F.col("_saying")[i] + prior_pages * F.aggregate("_saying", F.lit(0.0), lambda a, b: a + b) / max(pages_in_all, 1e-9))
                / (float(overall[i]) + prior_pages)
            )
            for i in range(places)
        ]).alias("_trust"),
    )

    base = F.array(*[F.lit(float(x)) for x in (overall + 1.0) / (overall.sum() + places)])

    def smoothed(counts: str, above: Column) -> Column:
        """Shares at a level, without the page's own, worth ``prior_pages`` pages of the level above."""
        rest = F.transform(
            F.arrays_zip(F.col(counts).alias("all"), F.col("_own").alias("own"), above.alias("above")),
            lambda z: F.greatest(z["all"] - z["own"], F.lit(0.0)) + prior_pages * z["above"],
        )
        whole = F.aggregate(rest, F.lit(0.0), lambda a, b: a + b)
        return F.transform(rest, lambda x: x / whole)

    joined = rows.join(levels, F.col("_host").eqNullSafe(F.col("_h"))).join(said, F.col("_declared").eqNullSafe(F.col("_d")))
    for counts, above, name in (
        ("_in_suffix", base, "_prior_suffix"),
        ("_in_parent", F.col("_prior_suffix"), "_prior_parent"),
        ("_in_host", F.col("_prior_parent"), "_prior_host"),
    ):
        joined = joined.withColumn(name, smoothed(counts, above))
    fused = joined.withColumn(
        "_posterior",
        normalised(F.transform(
            F.arrays_zip(F.col("_logs").alias("text"), F.col("_trust").alias("trust"), F.col("_prior_host").alias("prior")),
            lambda z: z["text"] + z["trust"] + F.log(z["prior"]),
        )),
    )
    names = F.array(*[F.lit(x) for x in model.languages])

    def best(values: str) -> Column:
        return F.element_at(names, F.array_position(F.col(values), F.array_max(values)).cast("int"))

    return fused.select(
        F.col("_id").alias(page_id),
        best("_posterior").alias("lang"),
        F.array_max("_posterior").alias("confidence"),
        F.when(F.array_min("_logs") < 0, best("_logs")).alias("text_lang"),
        F.col("_declared").alias("declared"),
    )
