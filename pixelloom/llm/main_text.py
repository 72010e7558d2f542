"""Main text of web pages by a conditional random field over their leaf blocks.

A page is read into leaf blocks (``html_blocks``). A block's features are the tags of its element and
of all around it, the words of their class, id and role, and the shape of its text: length, share of
links, signs, and the words of short ones. A linear-chain field (``crf``), whose steps tell whether
two neighbours have the same parent, labels all blocks of a page together by Viterbi. It is trained on
at most ``MAX_PAGES`` labelled pages, the caller's or those that ``page_samples`` sets, in one task;
what is sent to the executors is one weight for each of at most ``MAX_FEATURES`` features. Pages are
labelled where they lie: nothing is shuffled, and a page's text is never cut.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.llm import crf, page_samples
from pixelloom.llm.html_blocks import Leaf, Node, read_blocks

#: Labelled pages and different features that a model is trained on at most, and how often a feature must stand.
MAX_PAGES, MAX_FEATURES, LEAST = 800, 4000, 10
SHORT = 8  # words of a block whose words are features
SEED = 0
SECTIONS = frozenset("article main section nav aside header footer form dialog".split())
_LETTERS = re.compile(r"[^\W\d_]+")
_DIGITS = re.compile(r"[0-9]")
_ENDS = tuple(".!?…。:;")


def around(node: Node) -> frozenset[str]:
    """Features of an element: its own and all of those around it."""
    found = set()
    while node.tag:
        found.add(f"in {node.tag}")
        found.update(f"named {w}" for w in node.words)
        node = node.parent
    return frozenset(found)


def nearest_section(node: Node) -> str:
    while node.tag and node.tag not in SECTIONS:
        node = node.parent
    return node.tag


def sections(node: Node) -> str:
    """The two sectioning elements that lie nearest around, the outer one first."""
    found = []
    while node.tag and len(found) < 2:
        if node.tag in SECTIONS:
            found.append(node.tag)
        node = node.parent
    return ">".join(found[::-1])


def shape(leaf: Leaf) -> list[str]:
    """Features of a block's text and element."""
    text, tag, section = leaf.text, leaf.node.tag, nearest_section(leaf.node)
    words = text.count(" ") + 1
    size, linked = min(words.bit_length(), 8), leaf.linked / len(text)
    links = "none" if not leaf.linked else "few" if linked < 0.3 else "many" if linked < 0.8 else "all"
    lying = sections(leaf.node)
    found = [f"tag {tag}", f"lies {lying}", f"lies {lying} {tag}", f"section {section}", f"{section} {tag}", f"words {size}", f"links {links}", f"links {links} words {min(size, 4)}"]
    if text.endswith(_ENDS):
        found.append("ends")
    if "©" in text:
        found.append("copyright sign")
    if words <= SHORT:
        found += [f"word {w}" for w in {w.lower() for w in _LETTERS.findall(text)}]
        if len(_DIGITS.findall(text)) * 3 > len(text):
            found.append("digits")
    return found


def steps_of(leaves: list[Leaf]) -> list[int]:
    """For each block whether it has the parent and the names of the one before it (1), its section (2), or neither (0)."""
    kinds = [0]
    for a, b in zip(leaves, leaves[1:]):
        alike = a.node.parent is b.node.parent and a.node.words == b.node.words
        kinds.append(1 if alike else 2 if nearest_section(a.node) == nearest_section(b.node) else 0)
    return kinds[: len(leaves)]


def labels_of(leaves: list[Leaf], text: str) -> list[int] | None:
    """Which blocks the lines of ``text`` are, in order; None if a line is no block."""
    lines, labels, at = text.split("\n") if text else [], [], 0
    for leaf in leaves:
        labels.append(int(at < len(lines) and leaf.text == lines[at]))
        at += labels[-1]
    return labels if at == len(lines) else None


@dataclass
class Model:
    weights: dict[str, float]
    steps: list  # [kind][from][to]

    def labels(self, leaves: list[Leaf]) -> list[int]:
        own = self.weights.get
        emit = []
        for leaf in leaves:
            node = leaf.node
            if node.cache is None:
                node.cache = sum(own(f, 0.0) for f in around(node))
            emit.append(own("", 0.0) + node.cache + sum(own(f, 0.0) for f in shape(leaf)))
        return crf.decode(emit, steps_of(leaves), self.steps)

    def text(self, html: str | None) -> str:
        leaves = read_blocks(html)
        return "\n".join(leaf.text for leaf, label in zip(leaves, self.labels(leaves)) if label)


def learn(labelled: list[tuple[str, str]]) -> Model:
    """Train on pages and their main texts; pages whose lines are not their blocks are left out."""
    rows, counts = [], Counter()
    for html, text in labelled:
        leaves = read_blocks(html)
        labels = labels_of(leaves, text or "")
        if labels is None or not leaves:
            continue
        found = [["", *around(leaf.node), *shape(leaf)] for leaf in leaves]
        for own in found:
            counts.update(own)
        rows.append(list(zip(found, steps_of(leaves), labels)))
    names = [f for f, n in counts.most_common(MAX_FEATURES) if n >= LEAST]
    if not names:
        return Model({}, np.zeros((3, 2, 2)).tolist())
    at = {f: k for k, f in enumerate(names)}
    chains = crf.chains_of([[([at[f] for f in own if f in at], kind, label) for own, kind, label in row] for row in rows])
    weights, steps = crf.train(chains, len(names), 3)
    return Model(dict(zip(names, weights.tolist())), steps.tolist())


def fit(spark: SparkSession, labelled: DataFrame | None = None, max_pages: int = MAX_PAGES, seed: int = SEED) -> Model:
    """A model from ``labelled(html, text)``, one line of text for a block, or from pages set for it.

    Of more than ``max_pages`` those of the smallest hashes are taken.
    """
    composed = labelled is None
    if composed:
        source = spark.range(0, 1, 1, 1)
    else:
        order = F.xxhash64("html", "text", F.lit(seed))
        source = labelled.filter("html is not null").select("html", "text").orderBy(order, "html").limit(max_pages).coalesce(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = [batch.to_pydict() for batch in batches]
        model = learn(page_samples.pages(max_pages, seed) if composed else [p for g in given for p in zip(g["html"], g["text"])])
        steps = [(f"{k}{a}{b}", model.steps[k][a][b]) for k in range(3) for a in range(2) for b in range(2)]
        names, values = zip(*model.weights.items(), *steps)
        kinds = ["feature"] * len(model.weights) + ["step"] * len(steps)
        yield pa.record_batch([pa.array(kinds), pa.array(names), pa.array(values, pa.float64())], names=["kind", "name", "value"])

    rows = source.mapInArrow(run, "kind string, name string, value double").collect()
    if not rows:  # no partition at all
        return learn([])
    steps = {r.name: r.value for r in rows if r.kind == "step"}
    return Model({r.name: r.value for r in rows if r.kind == "feature"}, [[[steps[f"{k}{a}{b}"] for b in "01"] for a in "01"] for k in "012"])


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """Main text of each row of ``pages(page_id, url, html)``: its blocks, white space folded, one a line.

    A null or empty page, or one without main text, has an empty text. Rows that repeat, or have a null
    id or url, are pages of their own; other columns are ignored; an empty table gives no rows.
    """
    spark = pages.sparkSession
    own = model or fit(spark)
    sent = spark.sparkContext.broadcast((own.weights, own.steps))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Model(*sent.value)
        for batch in batches:
            texts = [reader.text(html.as_py()) for html in batch.column(2)]
            yield pa.record_batch(
                [*batch.columns[:2], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"]
            )

    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


#: What the model finds on pages of the given kind, whose main text stands in one article element.
CHECK = r"""
with cut as (select *, coalesce(regexp_extract(html, '<article>(.*?)(?:</article>|$)', 1, 's'), '') as article from pages),
parts as (select *, string_split_regex(article, '</?(?:p|h1)>') as blocks from cut),
plain as (
    select *, list_transform(blocks, lambda b: regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
        regexp_replace(b, '<br>', ' ', 'g'), '<[^>]*>', '', 'g'), '&quot;?', '"', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&amp;?', '&', 'g')) as texts
    from parts),
done as (
    select page_id, url, array_to_string(list_filter(list_transform(texts, lambda b: trim(regexp_replace(b, '\s+', ' ', 'g'))),
                                                     lambda b: b <> ''), chr(10)) as text
    from plain)
select page_id, url, coalesce(text, '') as text, cast(length(coalesce(text, '')) as bigint) as n_chars from done
"""
