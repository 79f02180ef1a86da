"""HTML extraction: gradient-boosted trees over DOM-node features, decoded over the tree.

A page is parsed into block elements; runs of text between their borders are its blocks. Each element has features of its
tag and attribute tokens, depth, subtree density (text, links, sentence ends), place and siblings, and its ancestors'
kinds. Attribute tokens (of class, id and role) are hashed, and what each says of an element and of those below it is learned: the
log-odds of its hash among labelled elements. The forest gives each element the odds that its own text belongs to the article.
Decoding is hierarchical: the kept set is the one with the highest sum of weighted log-odds in which whatever lies below a
dropped element is dropped, so ancestors and descendants cannot contradict each other.

Training is by weak labels from at most TRAIN_PAGES pages. Where a page has sectioning elements or attribute words that say so, these
label its elements; where it has none, elements whose text several different pages of the host share are template, and
of the others those of prose are article. Pages of one corpus look alike, so their elements are also shown in three other
guises: with all marks of kind taken off (the trees learn to judge pages without marks), with the other features of a
random element (they learn that marks outweigh place and size), and marked as away from the article (they learn that such a
mark rules an element out wherever it stands). Pages are extracted in the scan's own task; only the model is shipped.

Text: character references are decoded, white space within a block becomes one space, blocks are trimmed and joined in page
order by an empty line; empty blocks don't count; scripts, styles, templates, frames, form controls, comments and titles have
no text. Text of formulas, drawings and fallbacks within the article stays.

Defined cases: null or empty html, or a page without article text, gives an empty text; broken or cut-off markup is read as far
as it goes; a null page_id or url passes through; repeated rows are extracted one by one. Other columns are not read.
"""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keylake.llm import gbt
from keylake.llm.common import bounded_sample, load, spread, tidy

#: Training takes the pages with the smallest hash of their id, at most so many.
TRAIN_PAGES = 1000
#: At most so many of their elements are trained on.
TRAIN_NODES = 60 * TRAIN_PAGES

# fixed values: element kinds of the HTML standard
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template iframe textarea title select".split())
BLOCK = frozenset("html body article section main nav aside header footer div p ul ol li dl dt dd table thead tbody tfoot tr td th caption h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption form fieldset legend details summary address hr dialog menu center search hgroup button".split())
CLOSES_P = BLOCK - {"button", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend", "summary", "html", "body"}
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}}
LIMITS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "tbody": {"table"}}
#: Words in class, id and role that mark kinds of elements.
AWAY = re.compile(r"(?:^|[^a-z])(?:nav\w*|menu\w*|foot\w*|head(?:er)?|masthead|top-?bar|side\w*|aside|ads?|advert\w*|sponsor\w*|promo\w*|banner\w*|cookie\w*|consent|notice\w*|alert\w*|popup|modal|comment\w*|repl(?:y|ies)|disqus|respond|share\w*|sharing|social\w*|related|recommend\w*|more-?links|subscribe|newsletter|sign-?up|login|search\w*|form\w*|widget\w*|breadcrumbs?|pagination|pager|tags?|toc|copyright|legal|skip\w*|hidden|contentinfo|navigation|complementary|dialog)(?:$|[^a-z])")
TOWARDS = re.compile(r"(?:^|[^a-z])(?:article\w*|content(?!info)\w*|post\w*|entry\w*|body|main|story\w*|text|prose)(?:$|[^a-z])")
AWAY_TAGS, TOWARDS_TAGS = frozenset("nav footer aside form header menu button dialog search fieldset".split()), frozenset("article main".split())

#: Attribute tokens are known by so many hashes; elements of drawings and formulas may close themselves.
TOKENS, WORDS = 4096, re.compile(r"[^\W_]+")
DRAWN = frozenset("svg math path circle rect line polygon polyline ellipse use g image mspace none stop".split())
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.S)
SENTENCE_END = re.compile(r"[.!?。…](?:\s|$)")


@dataclass
class Node:
    """A block element: its own text blocks hold the page-order number of each."""

    tag: str
    parent: int
    depth: int
    away: bool = False
    towards: bool = False
    hidden: bool = False
    tokens: tuple[int, ...] = ()
    blocks: list[int] = field(default_factory=list)
    children: list[int] = field(default_factory=list)


def parse(page: str) -> tuple[list[Node], list[str], list[int]]:
    """Block elements in page order (the first is the root), text blocks, and the characters of each block within links."""
    nodes, texts, links = [Node("#root", -1, 0)], [], []
    open_: list[tuple[str, int]] = [("#root", 0)]  # tag and block element in force, inline elements too
    run: list[str] = []
    in_link = [0]
    held: Counter[str] = Counter()  # how many elements of each tag are open
    raw_end: str | None = None

    def flush():
        text = " ".join("".join(run).split())
        run.clear()
        if text:
            nodes[open_[-1][1]].blocks.append(len(texts))
            texts.append(text)
            links.append(min(in_link[0], len(text)))
        in_link[0] = 0

    def close(k: int):
        if any(tag in BLOCK for tag, _ in open_[k:]):
            flush()
        for tag, _ in open_[k:]:
            held[tag] -= 1
        del open_[k:]

    def say(data: str):
        if data:
            data = html.unescape(data) if "&" in data else data
            run.append(data)
            if held["a"]:
                in_link[0] += len(data)

    at = 0
    while at < len(page):
        m = TOKEN.search(page, at)
        if raw_end:
            end = re.compile(rf"</{re.escape(raw_end)}(?=[\s/>]|$)[^>]*(?:>|$)", re.I).search(page, at)
            at, raw_end = (end.end() if end else len(page)), None
            continue
        say(page[at : m.start() if m else len(page)])
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if not held[tag]:
                if tag in ("p", "br"):
                    run.append(" ")
                continue
            for k in range(len(open_) - 1, 0, -1):
                if open_[k][0] == tag:
                    close(k)
                    break
                if tag not in BLOCK and open_[k][0] in BLOCK:
                    break
            continue
        if tag in RAW:
            raw_end = tag
            if tag != "title":
                run.append(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag in ("br", "img", "input"):
                run.append(" ")
            continue
        if tag in ("html", "head", "body"):
            continue
        if tag in CLOSES_P:
            for k in range(len(open_) - 1, 0, -1):
                if open_[k][0] == "p":
                    close(k)
                    break
                if open_[k][0] in BLOCK:
                    break
        for k in range(len(open_) - 1, 0, -1):
            if open_[k][0] in LIMITS.get(tag, ()) or tag not in CLOSED_BY:
                break
            if open_[k][0] in CLOSED_BY[tag]:
                close(k)
        if tag in BLOCK:
            flush()
            parent = open_[-1][1]
            marks = {a[0].lower(): (a[1] or a[2] or a[3]).lower() for a in ATTRIBUTE.findall(m[3])} if m[3].strip() else {}
            words = " ".join(marks.get(k, "") for k in ("class", "id", "role"))
            hidden = "hidden" in marks or marks.get("aria-hidden") == "true" or "display:none" in marks.get("style", "").replace(" ", "")
            nodes.append(Node(tag, parent, nodes[parent].depth + 1, bool(words.strip() and AWAY.search(words)), bool(words.strip() and TOWARDS.search(words)), hidden, tuple({zlib.crc32(w.encode()) % TOKENS for w in WORDS.findall(words)})))
            nodes[parent].children.append(len(nodes) - 1)
            open_.append((tag, len(nodes) - 1))
        elif m[3].rstrip().endswith("/") and tag in DRAWN:
            continue
        else:
            open_.append((tag, open_[-1][1]))
        held[tag] += 1
    close(1)
    flush()
    return nodes, texts, links


GROUPS = {t: i for i, ts in enumerate(("article main", "section div #root", "p", "ul ol dl menu", "li dt dd", "nav", "header", "footer", "aside", "form fieldset button dialog search legend", "h1 h2 h3 h4 h5 h6", "table tbody thead tr td th", "blockquote pre figure figcaption")) for t in ts.split()}
NAMES = ("tag", "away", "towards", "hidden", "in_away", "in_towards", "depth", "own_chars", "own_links", "own_ends", "own_words", "chars", "link_share", "ends_share", "block_mean", "share_of_page", "blocks_above", "place", "siblings", "like_siblings", "before_chars", "after_chars", "parent_chars", "parent_links", "children", "tokens", "least_tokens", "most_tokens")
#: Features that name kinds, and which way the odds go with some features.
KINDS = [NAMES.index(k) for k in ("tag", "away", "towards", "hidden", "in_away", "in_towards", "tokens", "least_tokens", "most_tokens")]
MONOTONE = {NAMES.index(k): s for k, s in (("away", -1), ("hidden", -1), ("in_away", -1), ("in_towards", 1), ("link_share", -1))}
PLAIN, SECTIONING = GROUPS["div"], [GROUPS[t] for t in ("article", "nav", "header", "footer", "aside", "form")]


NO_ODDS = np.zeros(TOKENS)


def features(nodes: list[Node], texts: list[str], links: list[int], odds: np.ndarray = NO_ODDS) -> np.ndarray:
    """A row of NAMES for each element; odds says what each attribute token's hash speaks for."""
    n = len(nodes)
    chars, linked, ends, blocks = (np.zeros(n) for _ in range(4))
    own = np.zeros((n, 4))
    for i, node in enumerate(nodes):
        for b in node.blocks:
            own[i] += (len(texts[b]), links[b], len(SENTENCE_END.findall(texts[b])), texts[b].count(" ") + 1)
        chars[i], linked[i], ends[i], blocks[i] = *own[i, :3], len(node.blocks)
    for i in range(n - 1, 0, -1):
        p = nodes[i].parent
        chars[p] += chars[i]
        linked[p] += linked[i]
        ends[p] += ends[i]
        blocks[p] += blocks[i]
    out = np.zeros((n, len(NAMES)))
    in_away, in_towards = np.zeros(n), np.zeros(n)
    least, most = np.zeros(n), np.zeros(n)
    before = 0
    place = [0] * n
    for node in nodes:
        for k, child in enumerate(node.children):
            place[child] = k
    tags = [Counter(nodes[s].tag for s in node.children) for node in nodes]
    for i, node in enumerate(nodes):
        p = max(node.parent, 0)
        in_towards[i] = max(in_towards[p], node.towards or node.tag in TOWARDS_TAGS)
        in_away[i] = max(in_away[p], node.away or node.hidden or (node.tag in AWAY_TAGS and not (node.tag == "header" and in_towards[i])))
        own_odds = odds[list(node.tokens)] if node.tokens else NO_ODDS[:1]
        least[i], most[i] = min(least[p], own_odds.min()), max(most[p], own_odds.max())
        siblings = nodes[p].children if i else [0]
        k = place[i]
        like = tags[p][node.tag] / len(siblings) if i else 1.0
        out[i] = (GROUPS.get(node.tag, -1), node.away, node.towards, node.hidden, in_away[i], in_towards[i], node.depth, *own[i, :3], own[i, 3], chars[i], linked[i] / max(chars[i], 1), ends[i] / max(blocks[i], 1), chars[i] / max(blocks[i], 1), chars[i] / max(chars[0], 1), before, before / max(blocks[0], 1), len(siblings), like, chars[siblings[k - 1]] if k else 0, chars[siblings[k + 1]] if k + 1 < len(siblings) else 0, chars[p], linked[p] / max(chars[p], 1), len(node.children), own_odds.mean(), least[i], most[i])
        before += len(node.blocks)
    return out


def weak_labels(nodes: list[Node], x: np.ndarray, template: np.ndarray) -> np.ndarray:
    """1 or 0 for each element with text: by marks if the page has any, else by whether its text is the host's template, and prose."""
    col = lambda k: x[:, NAMES.index(k)]
    if col("in_towards").any():
        return (col("in_towards") > 0) & (col("in_away") == 0)
    return (col("in_away") == 0) & ~template & (col("link_share") < 0.4) & ((col("own_chars") >= 80) | (col("own_ends") > 0) | (col("parent_chars") >= 400))


def own_text(node: Node, texts: list[str]) -> int:
    """A hash of an element's own text."""
    return zlib.crc32("\n".join(texts[b] for b in node.blocks).encode())


def path_tokens(nodes: list[Node]) -> list[set[int]]:
    """Hashes of the attribute tokens of each element and its ancestors."""
    out: list[set[int]] = []
    for node in nodes:
        out.append(set(node.tokens) | (out[node.parent] if node.parent >= 0 else set()))
    return out


def token_odds(found: list[set[int]], y: np.ndarray, weight: float = 20.0) -> np.ndarray:
    """Log-odds of each token's hash against all elements, drawn to 0 where few show it."""
    yes, no = np.zeros(TOKENS), np.zeros(TOKENS)
    for tokens, label in zip(found, y.tolist(), strict=True):
        np.add.at(yes if label else no, list(tokens), 1)
    share = np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99)
    return np.round(np.log((yes + weight * share) / (no + weight * (1 - share))) - np.log(share / (1 - share)), 6) + 0.0


@dataclass
class Model:
    forest: gbt.Forest
    odds: np.ndarray = field(default_factory=lambda: NO_ODDS)


def decode(nodes: list[Node], texts: list[str], odds: np.ndarray) -> list[str]:
    """Blocks of the best set of elements closed under ancestors; an element's odds weigh by its own text."""
    own = np.array([sum(np.sqrt(len(texts[b])) for b in node.blocks) for node in nodes])
    worth = np.clip(odds, -4, 4) * own
    total = worth.copy()
    for i in range(len(nodes) - 1, 0, -1):
        # an element's own verdict also bears on what lies below it: one judged away costs a little even without text
        total[i] += min(odds[i], 0.0) * (own[i] == 0)
        if total[i] > 0:
            total[nodes[i].parent] += total[i]
    kept, open_ = [], np.zeros(len(nodes), bool)
    for i, node in enumerate(nodes):
        open_[i] = i == 0 or (open_[node.parent] and total[i] > 0)
        if open_[i] and (i or worth[0] > 0):
            kept += node.blocks
    return [texts[b] for b in sorted(kept)]


def extract(page: str | None, model: Model) -> str:
    """Main text of a page."""
    return extract_all([page], model)[0]


def extract_all(pages: list[str | None], model: Model) -> list[str]:
    parsed = [parse(p) if p else None for p in pages]
    x = [features(*p, model.odds) for p in parsed if p]
    odds = model.forest.margin(np.concatenate(x)) if x else np.zeros(0)
    out, at = [], 0
    for p in parsed:
        n = len(p[0]) if p else 0
        out.append("\n\n".join(decode(p[0], p[1], odds[at : at + n])) if p else "")
        at += n
    return out


def guises(x: np.ndarray, y: np.ndarray, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Training examples as they are, without marks, with strange other features, and marked as away."""
    r = np.random.default_rng(seed)
    tag, away, in_away = (NAMES.index(k) for k in ("tag", "away", "in_away"))
    bare = x.copy()
    bare[:, KINDS[1:]] = 0
    bare[np.isin(x[:, tag], SECTIONING), tag] = PLAIN
    strange = x.copy()
    strange[:, [j for j in range(x.shape[1]) if j not in KINDS]] = x[r.permutation(len(x))][:, [j for j in range(x.shape[1]) if j not in KINDS]]
    out = x[r.random(len(x)) < 0.5].copy()
    out[:, in_away] = 1
    out[:, away] = r.random(len(out)) < 0.5
    out[:, NAMES.index("least_tokens")] = np.where(r.random(len(out)) < 0.5, 0, x[:, NAMES.index("least_tokens")].min(initial=0))
    loose = out.copy()
    loose[:, [NAMES.index("in_towards"), NAMES.index("towards")]] = 0
    return np.concatenate([x, bare, strange, out, loose]), np.concatenate([y, y, y, np.zeros(2 * len(out))])


def train(pages: DataFrame, rows: int = TRAIN_PAGES, nodes: int = TRAIN_NODES) -> Model:
    """Fits the model to weak labels of at most so many pages (page_id, url, html) and elements: the sample is bounded, so the driver holds it."""
    some = bounded_sample(pages.where("html IS NOT NULL").select("page_id", "url", "html"), rows, "page_id", "html")
    host = F.coalesce(F.regexp_extract("url", r"^[a-zA-Z]+://([^/?#]*)", 1), F.lit(""))
    some = some.select("html", host.alias("host"), F.xxhash64("page_id", "html").alias("part"))

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for page, host, part in zip(batch["html"].to_pylist(), batch["host"].to_pylist(), batch["part"].to_pylist(), strict=True):
                tree, texts, links = parse(page)
                x = features(tree, texts, links)
                marked = weak_labels(tree, x, np.zeros(len(tree), bool))
                inner = weak_labels(tree, x, np.ones(len(tree), bool))  # what does not hang on templates
                known = path_tokens(tree)
                whole = zlib.crc32("\n".join(texts).encode())
                for i in np.flatnonzero(x[:, NAMES.index("own_chars")] > 0).tolist():
                    out.append({"part": part, "host": host, "page": whole, "digest": own_text(tree[i], texts), "label": bool(marked[i]), "sure": bool(inner[i]) == bool(marked[i]), "own": list(tree[i].tokens), "tokens": sorted(known[i]), "features": x[i].tolist()})
            yield pa.RecordBatch.from_pylist(out, EXAMPLE)

    got = some.mapInArrow(tidy(parsed), "part bigint, host string, page bigint, digest bigint, label boolean, sure boolean, own array<int>, tokens array<int>, features array<double>").orderBy("part", "features").limit(nodes).toPandas()
    # template: the same text on different pages of a host
    shared = got.groupby(["host", "digest"])["page"].transform("nunique") > 1 if len(got) else got["sure"]
    y = (got["label"] & (got["sure"] | ~shared)).to_numpy(float)
    odds = token_odds([set(t) for t in got["tokens"]], y)
    x = np.array(got["features"].tolist(), float).reshape(len(got), len(NAMES))
    for i, (own, tokens) in enumerate(zip(got["own"], got["tokens"], strict=True)):
        x[i, -3:] = (odds[own].mean() if len(own) else 0.0, odds[tokens].min(initial=0.0), odds[tokens].max(initial=0.0))
    both = guises(x, y)
    return Model(gbt.fit(*both, trees=40, depth=4, monotone=MONOTONE), odds)


EXAMPLE = pa.schema([("part", pa.int64()), ("host", pa.string()), ("page", pa.int64()), ("digest", pa.int64()), ("label", pa.bool_()), ("sure", pa.bool_()), ("own", pa.list_(pa.int32())), ("tokens", pa.list_(pa.int32())), ("features", pa.list_(pa.float64()))])


def extracted(pages: DataFrame, model: Model) -> DataFrame:
    """A row per page: page_id, url, text, n_chars."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                some = batch.slice(at, 128)
                texts = extract_all(some["html"].to_pylist(), model)
                yield pa.RecordBatch.from_arrays([some["page_id"], some["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(tidy(each), "page_id bigint, url string, text string, n_chars bigint")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = load(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extracted(spread(pages), train(pages))
