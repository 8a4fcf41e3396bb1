"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the DOM, decoded by Viterbi.

Features are the elements and the class, id and role words above a block, its nearest block element, and figures of its text and of its neighbours'.
The field is fitted once per process on generated labelled pages (`TRAIN_PAGES` of them, whatever the data).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chalkline.llm.common import rows_of, text_of
from chalkline.llm.crf import Chain, fit
from chalkline.llm.dom import ANCESTOR_BITS, Block, blocks_of
from chalkline.llm.labelled_pages import labelled_pages

TRAIN_PAGES = 600
#: Nearest block elements that are features of their own.
PARENTS = "p h1 h2 h3 h4 li div td th blockquote pre figcaption title button label option body dd dt".split()
_PARENT = {t: k for k, t in enumerate(PARENTS)}
OWN = 9
TEXT_AT = ANCESTOR_BITS + len(PARENTS)
FEATURES = TEXT_AT + OWN + 2 * 3


def _own(b: Block) -> tuple[float, ...]:
    n = b.text.count(" ") + 1
    return (1.0, min(n, 60) / 60, float(n < 5), float(n > 20), b.linked, float(b.linked > 0.6), float(b.text[-1] in ".!?:;\"'”»"),
            float("©" in b.text or "®" in b.text), min(sum(map(b.text.count, ".,;")), n) / n)


def features(blocks: list[Block]) -> np.ndarray:
    x = np.zeros((len(blocks), FEATURES))
    for i, b in enumerate(blocks):
        above, k = b.above, 0
        while above:
            if above & 1:
                x[i, k] = 1
            above >>= 1
            k += 1
        if b.parent in _PARENT:
            x[i, ANCESTOR_BITS + _PARENT[b.parent]] = 1
        x[i, TEXT_AT:TEXT_AT + OWN] = _own(b)
    near = x[:, TEXT_AT + 1:TEXT_AT + OWN:3][:, :3]
    x[1:, TEXT_AT + OWN:TEXT_AT + OWN + 3] = near[:-1]
    x[:-1, TEXT_AT + OWN + 3:] = near[1:]
    return x


@lru_cache(maxsize=1)
def trained(pages: int = TRAIN_PAGES) -> Chain:
    xs, ys, sizes = [], [], []
    for page, labels in labelled_pages(pages):
        blocks = blocks_of(page)
        xs.append(features(blocks))
        ys += [labels[b.text] for b in blocks]
        sizes.append(len(blocks))
    return fit(np.concatenate(xs), np.array(ys), np.array(sizes), l2=0.5)


def main_text(page: str, chain: Chain) -> str:
    """The blocks decoded as article, in page order, one to a line."""
    blocks = blocks_of(page)
    if not blocks:
        return ""
    states = chain.viterbi(chain.unary(features(blocks)).tolist())
    return "\n".join([b.text for b, s in zip(blocks, states) if s])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", chain: Chain | None = None) -> DataFrame:
    """(id, url, text, n_chars) of each row's whole page; null pages count as empty and give an empty text, repeated rows are kept."""
    chain = chain or trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(t[0], chain) for t in rows_of([batch], "body")]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                                             names=["id", "url", "text", "n_chars"])

    source = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), text_of(html_col).alias("body"))
    kinds = dict(source.dtypes)
    return source.mapInArrow(run, f"id {kinds['id']}, url {kinds['url']}, text string, n_chars long")
