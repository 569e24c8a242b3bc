"""Language of web pages by fusing what the text, the markup, the address and the rest of the host say."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.text import stored, whole

#: Byte trigrams are counted in this many hashed cells.
CELLS = 1 << 13
#: A text counts as at most this many independent trigrams, since neighbours in a text are far from independent.
EVIDENCE = 200.0
#: Pages that the level above weighs in a host's, domain's or suffix's prior.
SMOOTHING = 8.0
#: Languages whose cells are held in memory at a time; pages are read once for each such block.
BLOCK_LANGUAGES = 256
#: Bytes of a text whose trigrams are counted at a time.
BLOCK = 1 << 20


def _cell_counts(text: bytes) -> np.ndarray:
    """How often each cell of byte trigrams occurs in a text; lower-cased, spaces joined, one space at either end.

    Trigrams are counted in blocks, so a very long text costs its own bytes and one block.
    """
    data = np.frombuffer(b" " + b" ".join(text.decode("utf-8", "replace").lower().encode().split()) + b" ", np.uint8)
    counts = np.zeros(CELLS, np.int64)
    for start in range(0, len(data) - 2, BLOCK):
        wide = data[start : start + BLOCK + 2].astype(np.uint32)
        code = (wide[:-2] << np.uint32(16)) | (wide[1:-1] << np.uint32(8)) | wide[2:]
        counts += np.bincount((code * np.uint32(2654435761)) >> np.uint32(19), minlength=CELLS)
    return counts


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trigram counts of each language in this task: a row for each cell that occurs, again after each BLOCK_LANGUAGES."""
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if lang not in counts:
                if len(counts) == BLOCK_LANGUAGES:
                    yield from _cell_rows(counts)
                    counts = {}
                counts[lang] = np.zeros(CELLS, np.int64)
            counts[lang] += _cell_counts(text.as_buffer().to_pybytes())
    yield from _cell_rows(counts)


def _cell_rows(counts: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for lang, found in counts.items():
        cells = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(cells), pa.string()), pa.array(cells, pa.int32()), pa.array(found[cells])],
            names=["lang", "cell", "n"],
        )


@dataclass(frozen=True)
class Cells:
    """Cell counts of very many languages in the shared folder, from which tables are made for a block at a time."""

    counts: DataFrame
    langs: list[str]

    def blocks(self) -> Iterator[np.ndarray]:
        for start in range(0, len(self.langs), BLOCK_LANGUAGES):
            yield _table(self.counts, self.langs[start : start + BLOCK_LANGUAGES])


def _table(counts: DataFrame, langs: list[str]) -> np.ndarray:
    place = {lang: i for i, lang in enumerate(langs)}
    table = np.full((len(langs), CELLS), 0.5)
    for row in counts.filter(F.col("lang").isin(langs)).toLocalIterator():
        table[place[row["lang"]], row["cell"]] += row["n"]
    return np.log(table / table.sum(axis=1, keepdims=True))


def learn_any_languages(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang"
) -> tuple[list[str], np.ndarray | Cells]:
    """The languages in order, and the log probability of each trigram cell in each of them (add-half smoothing).

    Counts cover every row of docs that has a text and a language; without any there are no languages. The table has
    CELLS numbers for each language; beyond BLOCK_LANGUAGES it is left in the shared folder and read in blocks.
    """
    rows = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).filter(
        F.col("lang").isNotNull() & (F.col("text") != "")
    )
    counts = rows.select("lang", F.col("text").cast("binary").alias("text")).mapInArrow(
        _counted, "lang string, cell int, n long"
    )
    summed = stored(counts.groupBy("lang", "cell").agg(F.sum("n").alias("n")))
    langs = sorted(r["lang"] for r in summed.select("lang").distinct().toLocalIterator())
    return langs, _table(summed, langs) if len(langs) <= BLOCK_LANGUAGES else Cells(summed, langs)


def learn_languages(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang"
) -> tuple[list[str], np.ndarray | Cells]:
    """As learn_any_languages, but labelled text is required."""
    langs, table = learn_any_languages(docs, text_col, lang_col)
    if not langs:
        raise ValueError("no labelled text to learn from")
    return langs, table


def _scored(table: np.ndarray, name: str, last: bool):
    """Adds the likelihoods of the table's languages under this name; the text goes with the last block."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column("text"):
                counts = _cell_counts(text.as_buffer().to_pybytes())
                cells = np.flatnonzero(counts)
                total = table[:, cells] @ counts[cells]
                out.append((total * min(1.0, EVIDENCE / max(1, counts.sum()))).tolist())
            keep = [n for n in batch.schema.names if n != "text" or not last]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(n) for n in keep], pa.array(out, pa.list_(pa.float64()))], names=[*keep, name]
            )

    return run


def _with_likelihood(rows: DataFrame, table: np.ndarray, name: str, last: bool) -> DataFrame:
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text" or not last]
    return rows.mapInArrow(_scored(table, name, last), ", ".join([*kinds, f"{name} array<double>"]))


#: Second labels that country registries use as part of the suffix.
SECOND_LABELS = ("ac", "co", "com", "edu", "go", "gov", "ne", "net", "or", "org")


def visible_text(html: Column) -> Column:
    """The text between tags; scripts, styles, comments and character references go."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    return F.btrim(F.regexp_replace(bare, r"(?s)<[^>]*>|&#?\w+;|\s+", " "))


def page_fields(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> dict[str, Column]:
    """What a page says about its language beside its text: its markup, and its address from suffix to host."""
    html, url = whole(F.col(html_col)), whole(F.col(url_col))
    declared = F.lower(F.regexp_extract(html, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})\b", 1))
    host = F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/:?#]+)", 1))
    labels = F.split(host, r"\.")
    # Under some country suffixes names are registered one label further down.
    below = (F.length(F.element_at(labels, -1)) == 2) & F.get(labels, F.size(labels) - 2).isin(*SECOND_LABELS)
    parts = F.when((F.size(labels) > 2) & below, F.lit(3)).otherwise(F.lit(2))
    return {
        "declared": declared,
        "host": host,
        "domain": F.array_join(F.slice(labels, F.greatest(F.size(labels) + 1 - parts, F.lit(1)), parts), "."),
        "suffix": F.element_at(labels, -1),
        "text": visible_text(html),
    }


def page_languages(
    pages: DataFrame,
    langs: list[str],
    table: np.ndarray | Cells,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    smoothing: float = SMOOTHING,
) -> DataFrame:
    """page_id, lang, posterior, text_lang, declared and host for each row of pages.

    The posterior is proportional to the likelihood of the text, that of the declared language, and the prior of the
    host. The likelihood of a declaration is counted against the languages that the texts alone give. A host's prior is
    its pages' counts, smoothed by its domain's, these by its address suffix's, these by all pages'; so the suffix counts
    once, and most where host and domain say little. A page's own vote is left out at every level. All counts are grouped
    aggregates, joined back by key. The posterior is rounded to 12 places: sums differ in the last.

    A null or empty page has no text evidence: its text_lang is null and it casts no vote, and its host decides. A
    missing address or declaration is a value of its own. Repeated rows each count. An empty table gives no rows. Without
    languages every page has a null lang, posterior and text_lang. Any number of languages is scored, in blocks; a page
    has one number for each of them.
    """
    n = len(langs)
    every = F.sequence(F.lit(0), F.lit(n - 1))
    raw = pages.select(F.col(id_col).alias("page_id"), F.struct("*").alias("page"))
    fields = page_fields(pages, f"page.{url_col}", f"page.{html_col}")
    rows = raw.select("page_id", *[c.alias(k) for k, c in fields.items() if k != "text"], fields["text"].cast("binary").alias("text"))
    said_fields = [c for c in rows.columns if c != "text"]
    if not n:
        nulls = [F.lit(None).cast(t).alias(c) for c, t in (("lang", "string"), ("posterior", "double"), ("text_lang", "string"))]
        return rows.select("page_id", *nulls, *[F.nullif(c, F.lit("")).alias(c) for c in ("declared", "host")])
    if isinstance(table, np.ndarray):
        scored = _with_likelihood(rows, table, "likelihood", True)
    else:
        names = [f"likelihood_{i}" for i in range(0, n, BLOCK_LANGUAGES)]
        scored = rows
        for name, block in zip(names, table.blocks(), strict=True):
            scored = stored(_with_likelihood(scored, block, name, name == names[-1]))
        scored = scored.select(*said_fields, F.concat(*names).alias("likelihood"))
    best = F.when(
        F.array_max("likelihood") < 0, F.array_position("likelihood", F.array_max("likelihood")).cast("int") - 1
    )
    voted = stored(scored.withColumn("vote", best))

    def counted(*keys: str) -> DataFrame:
        if n > BLOCK_LANGUAGES:  # too many for an expression each
            votes = voted.groupBy(*keys, "vote").agg(F.count("vote").alias("n"))
            entries = F.collect_list(F.when(F.col("vote").isNotNull(), F.struct("vote", "n")))
            known_votes = votes.groupBy(*keys).agg(F.map_from_entries(entries).alias("votes"))
            filled = F.transform(every, lambda i: F.coalesce(F.try_element_at("votes", i), F.lit(0).cast("long")))
            return known_votes.select(*keys, filled.alias(f"by_{keys[-1]}"))
        counts = [F.count_if(F.col("vote") == i) for i in range(n)]
        return voted.groupBy(*keys).agg(F.array(*counts).alias(f"by_{keys[-1]}"))

    votes_for = {r["vote"]: r["count"] for r in voted.groupBy("vote").count().collect()}
    known = F.array(*[F.lit(votes_for.get(i, 0)).cast("long") for i in range(n)])
    hosts = stored(
        counted("suffix", "domain", "host")
        .join(counted("suffix", "domain"), ["suffix", "domain"])
        .join(counted("suffix"), "suffix")
        .select("host", "by_host", "by_domain", "by_suffix")
    )
    said = stored(counted("declared"))
    joined = voted.join(hosts, "host").join(said, "declared")
    own = lambda i: F.coalesce((F.col("vote") == i).cast("long"), F.lit(0).cast("long"))

    def without_own(counts: Column) -> Column:
        return F.transform(every, lambda i: F.get(counts, i) - own(i))

    rest = joined.select(
        "page_id", "declared", "host", "likelihood", "vote", "by_declared",
        without_own(known).alias("all"),
        *[without_own(F.col(c)).alias(c) for c in ("by_host", "by_domain", "by_suffix")],
    )

    def total(c: str) -> Column:
        return F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)

    sizes = rest.select("*", *[total(c).alias(f"n_{c}") for c in ("all", "by_suffix", "by_domain", "by_host")])
    prior = lambda i: (F.get("all", i) + 1.0) / (F.col("n_all") + float(n))
    levels = [prior]
    for c in ("by_suffix", "by_domain", "by_host"):
        above = levels[-1]
        levels.append(
            lambda i, c=c, above=above: (F.get(c, i) + F.lit(smoothing) * above(i)) / (F.col(f"n_{c}") + F.lit(smoothing))
        )
    declared = lambda i: (F.get("by_declared", i) - own(i) + 1.0) / (F.get("all", i) + 1.0 + float(n))
    logs = sizes.select(
        "page_id", "declared", "host", "vote",
        F.transform(
            every,
            lambda i: F.get("likelihood", i) + F.log(declared(i)) + F.log(levels[-1](i)),
        ).alias("logs"),
    )
    top = F.array_max("logs")
    names = F.array(*[F.lit(x) for x in langs])
    share = F.aggregate("logs", F.lit(0.0), lambda a, x: a + F.exp(x - top))
    return logs.select(
        "page_id",
        F.get(names, F.array_position("logs", top).cast("int") - 1).alias("lang"),
        F.round(1.0 / share, 12).alias("posterior"),
        F.get(names, F.col("vote")).alias("text_lang"),
        F.nullif("declared", F.lit("")).alias("declared"),
        F.nullif("host", F.lit("")).alias("host"),
    )

