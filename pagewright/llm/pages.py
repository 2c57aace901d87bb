"""One pass over extraction results: lines, block rules, residue and stuffing flags, text statistics.

`page_facts` is the shared first stage of problems 1 to 5: each page is parsed once in an
Arrow-batched Python stage, and everything that follows is DataFrame work on small
columns. `staged_facts` writes those columns once, for all queries of a session over the
same table. The models are fitted on a bounded sample whose pages are parsed on the
executors; the driver gets token hashes and labels alone, whose number the sample bounds.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.llm.blocks import BAD, Block, blocks_of, mark_blocks
from pagewright.llm.furniture import fit_furniture, labels_of, named, score_lines
from pagewright.llm.furniture import signs_of as furniture_signs
from pagewright.llm.linear import Stretches, fit
from pagewright.llm.residue import TITLE, are_residue, judged, labelled
from pagewright.llm.stuffing import PROSE, LineModel, body_flags, fit_line_model, is_stuffed, read_signs, states_of
from pagewright.llm.tables import bounded_sample, common_words, fingerprint, once, read_table, site_of, stage, tune
from pagewright.session import spread

#: Rows of the sample that the residue classifier is fitted on, and of its part for the line models; the longest text and markup in it.
SAMPLE_ROWS, LINE_ROWS, SAMPLE_CHARS, SAMPLE_MARKUP = 5000, 2500, 60_000, 250_000
#: Of the sample's sentences that no pattern knows, one in so many is shown to the residue classifier.
PLAIN_SENTENCES = 3
#: Characters of text and markup that are held parsed at a time, unless one page has more.
GROUP_CHARS = 3_000_000

FACTS = T.StructType(
    [
        T.StructField("residue", T.BooleanType()),
        T.StructField("stuffed", T.BooleanType()),
        T.StructField("base_lang", T.StringType()),
        T.StructField("body_words", T.IntegerType()),
        T.StructField("body_chars", T.IntegerType()),
        T.StructField("mean_word_length", T.DoubleType()),
        T.StructField("symbol_ratio", T.DoubleType()),
        T.StructField("punct_line_share", T.DoubleType()),
        T.StructField("common_word_share", T.DoubleType()),
        T.StructField("prose_word_share", T.DoubleType()),
        T.StructField("noise_lines", T.ArrayType(T.IntegerType())),
    ]
)
INPUTS = ("title", "text_content", "cleaned_html", "byline", "author", "site_name", "lang")

_BY = re.compile(r"^(?:by|von|par|por)\s+", re.I)
_END = re.compile(r"[.!?…][\"'»“”’)\]]*$")
_LANG = re.compile(r"^([a-z]{2,3})(?:[-_].*)?$")


@dataclass
class PageModels:
    """What the page stage needs on each executor; its size does not depend on the corpus."""

    words: dict
    stop: frozenset
    furniture: tuple[np.ndarray, np.ndarray]
    residue: np.ndarray
    lines: LineModel


@dataclass(slots=True)
class Page:
    """A page's columns, and its lines once it is parsed."""

    title: str | None
    text_content: str | None
    cleaned_html: str | None
    byline: str | None
    author: str | None
    site_name: str | None
    lang: str | None
    blocks: list[Block]

    def names(self) -> tuple[str | None, str | None]:
        return _BY.sub("", self.byline.strip()) if self.byline else None, self.author


def pages_of(frame: pd.DataFrame) -> list[Page]:
    lists = [[x if isinstance(x, str) else None for x in frame[c]] for c in INPUTS]
    return [Page(*values, []) for values in zip(*lists)]


def groups(pages: list[Page]) -> Iterator[list[Page]]:
    """The pages in their order, so many at a time that what is parsed stays small."""
    held, size = [], 0
    for page in pages:
        held.append(page)
        size += len(page.text_content or "") + len(page.cleaned_html or "")
        if size >= GROUP_CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


def parse(pages: list[Page], stop: frozenset) -> list[tuple[list[Block], str, list[str]]]:
    """(blocks, site, people) of each page, the blocks not marked yet."""
    for page in pages:
        page.blocks = blocks_of(page.text_content, page.cleaned_html, stop)
    return [(page.blocks, *named(*page.names(), page.site_name)) for page in pages]


def mark(pages: list[Page], stop: frozenset, furniture: tuple[np.ndarray, np.ndarray]) -> None:
    """Parse the pages and mark their blocks."""
    score_lines(parse(pages, stop), furniture)
    for page in pages:
        if page.blocks:
            mark_blocks(page.blocks, page.title, page.names(), page.site_name)


def language_of(lang: str | None, blocks: list, words: dict) -> str:
    """The base language in lower case; where none is recorded, the one whose common words the text uses most."""
    hit = _LANG.match(lang.strip().lower()) if lang else None
    if hit:
        return hit.group(1)
    best, most = "und", 0
    for name, own in sorted(words.items()):
        score = sum(w in own for b in blocks for w in b.words)
        if score > most:
            best, most = name, score
    return best


def facts_of(page: Page, residue: bool, models: PageModels) -> tuple:
    """The facts of one marked page. A page without text has no body and no noise lines."""
    blocks = page.blocks
    states = states_of(blocks, models.lines)
    body = body_flags(blocks)
    stuffed = is_stuffed(blocks, states, body)
    words = chars = letters = symbols = ended = lines = prose = 0
    common = 0.0
    for b, state, counts in zip(blocks, states, body):
        if not counts:
            continue
        n = len(b.words)
        words += n
        prose += n if state == PROSE else 0
        common += b.stop * n
        letters += sum(map(len, b.words))
        chars += len(b.text)
        symbols += b.marks
        ended += bool(_END.search(b.text))
        lines += 1
    of = max(1, words)
    noise = [b.line_no for b in blocks if b.mark == BAD]
    return (bool(residue), stuffed, language_of(page.lang, blocks, models.words), words, chars, letters / of, symbols / max(1, chars), ended / max(1, lines), common / of, prose / of, noise)


def page_stage(models: PageModels):
    """The Arrow-batched page stage as a column function over `INPUTS`."""
    columns = [f.name for f in FACTS]

    def run(title, text_content, cleaned_html, byline, author, site_name, lang):
        rows = []
        for pages in groups(pages_of(pd.DataFrame(dict(zip(INPUTS, (title, text_content, cleaned_html, byline, author, site_name, lang)))))):
            mark(pages, models.stop, models.furniture)
            flags = are_residue([(page.title, page.blocks) for page in pages], models.residue)
            for page, residue in zip(pages, flags):
                rows.append(facts_of(page, residue, models))
                page.blocks = []
        return pd.DataFrame(rows, columns=columns)

    run.__annotations__ = {k: pd.Series for k in INPUTS} | {"return": pd.DataFrame}
    return F.pandas_udf(run, FACTS).asNondeterministic()


# --- fitting --------------------------------------------------------------------------


def _ints(values, kind) -> bytes:
    return np.fromiter(values, kind).tobytes()


def _pack(codes: list[list[int]], signs: list[tuple[int, ...]]) -> tuple[bytes, bytes, bytes, bytes]:
    return _ints((c for x in codes for c in x), np.uint32), _ints(map(len, codes), np.int32), _ints((c for x in signs for c in x), np.uint32), _ints(map(len, signs), np.int32)


_PACKED = "codes binary, sizes binary, signs binary, sign_sizes binary"
LINE_ROW = f"site string, {_PACKED}, own binary, opens binary, main binary"
SENTENCE_ROW = f"site string, nth double, {_PACKED}, labels binary, phrases array<string>, lines binary, guesses binary"


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split(" ")[0] for c in schema.split(", ")])


def line_examples(stop: frozenset):
    """For `mapInPandas`: token hashes, signs and labels by markup of the lines of sampled pages."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for (blocks, site, people), host in zip(parse(pages_of(frame), stop), frame["site"]):
                labels = labels_of(blocks)
                rows.append((host, *_pack([b.codes for b in blocks], [furniture_signs(b, site, people) for b in blocks]), _ints((x for x, _ in labels), np.int8), _ints((x for _, x in labels), np.int8), _ints((b.role > 0 for b in blocks), np.int8)))
            yield _frame(rows, LINE_ROW)

    return run


def sentence_examples(stop: frozenset, furniture: tuple[np.ndarray, np.ndarray]):
    """For `mapInPandas`: token hashes, signs and weak labels of titles and sentences of sampled pages, and the signs of their lines.

    Of the sentences that no pattern knows one in `PLAIN_SENTENCES` is kept, by a hash of its tokens.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            pages = pages_of(frame)
            mark(pages, stop, furniture)
            for page, host, nth in zip(pages, frame["site"], frame["nth"]):
                kept = [(c, s, y, p) for c, s, (y, p) in zip(*judged(page.title, page.blocks), labelled(page.title, page.blocks)) if y >= 0 and (y or p or c[:1] == [TITLE] or sum(c) % PLAIN_SENTENCES == 0)]
                signs, guesses = read_signs(page.blocks)
                rows.append((host, nth, *_pack([x[0] for x in kept], [x[1] for x in kept]), _ints((x[2] for x in kept), np.int8), [x[3] for x in kept], signs.astype(np.int8).tobytes(), guesses.astype(np.int8).tobytes()))
            yield _frame(rows, SENTENCE_ROW)

    return run


def _joined(rows: list, column: str, kind) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *(np.frombuffer(r[column], kind) for r in rows)])


def stretches_of(rows: list) -> Stretches:
    return Stretches.flat(*(_joined(rows, c, k) for c, k in (("codes", np.uint32), ("sizes", np.int32), ("signs", np.uint32), ("sign_sizes", np.int32))))


@dataclass
class Sample:
    """What the driver keeps of the sampled pages."""

    furniture: tuple[np.ndarray, np.ndarray]
    sentences: list  #: rows of `SENTENCE_ROW`


def read_sample(pages: DataFrame, stop: frozenset) -> Sample:
    """Stage the sampled rows, parse them on the executors, and fit the furniture classifiers that the block rules need."""
    chosen = bounded_sample(pages.select("result_id", "url", *INPUTS), "result_id", SAMPLE_ROWS, {"text_content": SAMPLE_CHARS, "cleaned_html": SAMPLE_MARKUP})
    sample = spread(stage(chosen.select(site_of(F.col("url")).alias("site"), "nth", *INPUTS), "sample"))
    some = sample.where(F.col("nth") < LINE_ROWS)
    lines = some.mapInPandas(line_examples(stop), LINE_ROW).collect()  # at most 2 x LINE_ROWS rows
    furniture = fit_furniture([r["site"] for r in lines], [len(r["own"]) for r in lines], stretches_of(lines), _joined(lines, "own", np.int8), _joined(lines, "opens", np.int8), _joined(lines, "main", np.int8) > 0)
    return Sample(furniture, sample.mapInPandas(sentence_examples(stop, furniture), SENTENCE_ROW).collect())  # at most 2 x SAMPLE_ROWS rows


def train(spark: SparkSession, base: str, pages: DataFrame) -> PageModels:
    """Fit the models on a bounded sample (`SAMPLE_ROWS`); an empty table gives models that flag nothing."""
    words = common_words(spark, base)
    stop = frozenset(w for own in words.values() for w in own)
    sample = read_sample(pages, stop)
    residue = fit(stretches_of(sample.sentences), _joined(sample.sentences, "labels", np.int8), epochs=16)
    lines = fit_line_model([(r["lines"], r["guesses"]) for r in sample.sentences if r["nth"] < LINE_ROWS])
    return PageModels(words, stop, sample.furniture, residue, lines)


def page_facts(spark: SparkSession, base: str) -> DataFrame:
    """result_id, url, text_content and the `FACTS` of each page.

    Rows with a null result_id have no identity and are left out. Rows that repeat a
    result_id are kept as they are. Columns beyond those read are ignored.
    """
    tune(spark)
    pages = read_table(spark, base, "extraction_results").where(F.col("result_id").isNotNull())
    models = once(spark, ("models", *fingerprint(spark, base, "extraction_results", "common_words")), lambda: train(spark, base, pages))
    rows = spread(pages.select("result_id", "url", *INPUTS))
    out = rows.select("result_id", "url", "text_content", page_stage(models)(*INPUTS).alias("facts"))
    return out.select("result_id", "url", "text_content", "facts.*")


def staged_facts(spark: SparkSession, base: str) -> DataFrame:
    """`page_facts` without the texts, written once a session for each state of the table's files."""
    return once(spark, ("facts", *fingerprint(spark, base, "extraction_results", "common_words")), lambda: stage(page_facts(spark, base).drop("text_content"), "facts"))
