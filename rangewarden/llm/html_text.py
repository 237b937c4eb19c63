"""The main text of web pages, by boosted trees over DOM nodes and a decoding that respects the tree."""

from __future__ import annotations

import html
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rangewarden.llm._common import batched, freed, record, table
from rangewarden.llm.boosting import Boosted
from rangewarden.llm.html_dom import UNSEEN, Dom

#: Words of class, id and role attributes by what they speak for, and groups of tags.
TOKENS = {
    "main": "article content post entry body story text main prose",
    "menu": "nav navigation menu breadcrumb breadcrumbs pagination pager toc tabs tags skip",
    "head": "header masthead banner topbar logo branding",
    "foot": "footer foot copyright colophon legal",
    "side": "sidebar aside related recommended widget rail trending popular teaser complementary",
    "note": "cookie cookies consent notice gdpr alert popup modal overlay paywall hidden",
    "ad": "ad ads advert adverts advertisement promo sponsor sponsored banner",
    "form": "form newsletter subscribe subscription signup login search contact",
    "reply": "comment comments reply replies respond discussion disqus reader",
    "share": "share social sharing follow author byline meta",
}
TAGS = {"article": "article main", "nav": "nav menu", "header": "header", "footer": "footer", "aside": "aside", "form": "form input button select label fieldset", "p": "p blockquote pre", "list": "ul ol li dl dt dd", "heading": "h1 h2 h3 h4 h5 h6", "box": "div section", "table": "table tr td th tbody thead", "link": "a", "text": "#text"}
_TOKEN = {w: i for i, (_, words) in reversed(list(enumerate(TOKENS.items()))) for w in words.split()}
_TAG = {w: i for i, (_, words) in enumerate(TAGS.items()) for w in words.split()}
FEATURES = [*(f"token_{k}" for k in TOKENS), *(f"above_{k}" for k in TOKENS), *(f"tag_{k}" for k in TAGS), *(f"above_tag_{k}" for k in TAGS), "log_chars", "link_share", "chars_per_node", "log_nodes", "words", "stops", "paragraphs", "depth", "sibling", "siblings", "share_of_parent", "share_before", "share_of_page", "same_tag", "previous_chars", "next_chars", "inputs", "headings", *(f"parent_{k}" for k in ("log_chars", "link_share", "paragraphs", "headings", "inputs", "stops", "share_of_page")), "above_paragraphs", "above_link_share"]


def features(dom: Dom) -> np.ndarray:
    """A row for each node, in the order of FEATURES: of its own, of what stands above it, of its subtree and of its siblings."""
    n, parent, tag = len(dom.tag), dom.parent, dom.tag
    chars, links, nodes, stops, words, paras, inputs, heads = (np.zeros(n) for _ in range(8))
    token, above = np.zeros((n, len(TOKENS))), np.zeros((n, len(TOKENS)))
    tags, above_tags = np.zeros((n, len(TAGS))), np.zeros((n, len(TAGS)))
    depth, index, kids = [0] * n, [0] * n, [0] * n
    unseen, in_link = [False] * n, [False] * n
    before, run = np.zeros(n), 0
    for i in range(n):
        p = parent[i]
        before[i] = run
        if i:
            depth[i], index[i] = depth[p] + 1, kids[p]
            kids[p] += 1
            unseen[i] = unseen[p] or tag[i] in UNSEEN
            in_link[i] = in_link[p] or tag[i] == "a"
        if (k := _TAG.get(tag[i])) is not None:
            tags[i, k] = 1
        for w in dom.tokens[i]:
            if (k := _TOKEN.get(w)) is not None:
                token[i, k] = 1
        if i:
            above[i], above_tags[i] = np.maximum(above[p], token[p]), np.maximum(above_tags[p], tags[p])
        if tag[i] == "#text":
            if not unseen[i] and (t := dom.text[i].strip()):
                chars[i], words[i] = len(t), t.count(" ") + 1
                stops[i] = t.count(".") + t.count("!") + t.count("?")
                links[i] = len(t) if in_link[i] else 0
                run += len(t)
        else:
            nodes[i] = 1
            paras[i], heads[i], inputs[i] = tag[i] == "p", tag[i] in ("h1", "h2", "h3"), tag[i] in ("input", "button", "select", "textarea", "label")
    for v in (chars, links, nodes, stops, words, paras, inputs, heads):
        for i in range(n - 1, 0, -1):
            if v[i]:
                v[parent[i]] += v[i]
    par = np.maximum(np.array(parent), 0)
    index, kids, depth = np.array(index), np.array(kids), np.array(depth)
    order = np.lexsort([index, par])
    previous, following = np.zeros(n), np.zeros(n)
    same = par[order][1:] == par[order][:-1]
    previous[order[1:]] = np.where(same, chars[order[:-1]], 0)
    following[order[:-1]] = np.where(same, chars[order[1:]], 0)
    kinds = np.array([_TAG.get(t, len(TAGS)) for t in tag]) + par * (len(TAGS) + 1)
    _, inverse, count = np.unique(kinds, return_inverse=True, return_counts=True)
    total = max(1.0, chars[0])
    rest = [np.log1p(chars), links / np.maximum(chars, 1), chars / np.maximum(nodes, 1), np.log1p(nodes), np.log1p(words), stops / np.maximum(words, 1), np.log1p(paras), depth, index, kids[par], chars / np.maximum(chars[par], 1), before / total, chars / total, count[inverse] / np.maximum(kids[par], 1), np.log1p(previous), np.log1p(following), np.log1p(inputs), np.log1p(heads)]
    over = par[par]
    rest += [np.log1p(chars[par]), links[par] / np.maximum(chars[par], 1), np.log1p(paras[par]), np.log1p(heads[par]), np.log1p(inputs[par]), stops[par] / np.maximum(words[par], 1), chars[par] / total, np.log1p(paras[over]), links[over] / np.maximum(chars[over], 1)]
    return np.concatenate([token, above, tags, above_tags, np.stack(rest, axis=1)], axis=1)


#: What it costs, in log odds, to split a node into both kinds, and to leave a part of main text out.
MIXED, DROP = -2.0, -4.0


def decode(dom: Dom, odds: np.ndarray, mixed: float = MIXED, drop: float = DROP) -> list[bool]:
    """Whether each node is main text: the most probable assignment in which the tree agrees with itself.

    A node is boilerplate, and so is all below it; or main text, and then what is below is main text, or
    boilerplate at a cost; or mixed, at a cost, and then anything may be below it but text itself is one or the other.
    """
    n, parent = len(dom.tag), dom.parent
    yes, no = -np.logaddexp(0, -odds), -np.logaddexp(0, odds)
    out, main, mix = no.tolist(), yes.tolist(), [mixed] * n
    for i in range(n):
        if dom.tag[i] == "#text":
            mix[i] = float("-inf")
        if dom.tag[i] in UNSEEN:
            main[i] = mix[i] = float("-inf")
    for i in range(n - 1, 0, -1):
        p = parent[i]
        out[p] += out[i]
        main[p] += max(main[i], out[i] + drop)
        mix[p] += max(main[i], out[i], mix[i])
    state = [0] * n
    for i in range(n):
        above = state[parent[i]] if i else 2
        if above == 2:
            best = max(main[i], out[i], mix[i])
            state[i] = 1 if best == main[i] else 2 if best == mix[i] else 0
        else:
            state[i] = int(above == 1 and main[i] >= out[i] + drop)
    return [s == 1 for s in state]


def main_text(dom: Dom, kept: list[bool]) -> str:
    """White space inside a block becomes one blank; blocks in page order are joined by one blank."""
    parts: list[str] = []
    for i, (tag, keep) in enumerate(zip(dom.tag, kept, strict=True)):
        if tag == "#text":
            if dom.breaks[i]:
                parts.append(" ")
            if keep:
                parts.append(dom.text[i])
    return " ".join("".join(parts).split())


#: How invented pages are laid out, and how often: by tags that tell, by attributes that tell, by neither, as a table, or as a piece of a page that is all text.
STYLES = {"semantic": 28, "marked": 24, "bare": 26, "table": 8, "fragment": 14}


def made_page(rng: random.Random, style: str | None = None) -> tuple[str, bool]:
    """An invented page, and whether all of it is main text. data-k marks the roots of main text (1) and of boilerplate (0)."""
    style = style or rng.choices(list(STYLES), list(STYLES.values()))[0]
    letters = "abcdefghijklmnopqrstuvwxyzéäñ"
    pool = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 9))) for _ in range(60)]
    word = lambda: rng.choice(pool)
    odd = rng.random() < 0.25  # a page whose words have digits and signs

    def sentence(n: int | None = None) -> str:
        ws = [word() + (rng.choice("0123456789%$#*&,;:)") * rng.randint(1, 3) if odd and rng.random() < 0.5 else "") for _ in range(n or rng.randint(1, 18))]
        return html.escape(" ".join([ws[0].title(), *ws[1:]]), quote=False) + rng.choice([".", ".", ".", "", "!", "?"])

    def inline(body: str) -> str:
        name = rng.choice(["b", "i", "em", "strong", "span", "code"])
        return rng.choice([f"<{name}>{body}</{name}>", f"<{name}>{body}</{name}>", f"<{name}>{body}", f"{sentence()} <{name}>{word()}</{name}> {body}", body.replace(" ", "<br>", 1)])

    def para(least: int = 1) -> str:
        body = " ".join(sentence() for _ in range(rng.choice([1, 1, 2, 4, 8, 20]) + least - 1))
        if rng.random() < 0.2:
            body = inline(body)
        if rng.random() < 0.15:
            body += f' <a href="/{word()}">{word()}</a> {sentence()}'
        return rng.choice([f"<p>{body}</p>"] * 5 + [f"<p>{body}", f"<blockquote>{body}</blockquote>", f"<ul><li>{body}</li><li>{sentence()}</li></ul>", f"<h2>{sentence(4)}</h2><p>{body}</p>", f"<table><tr><td>{body}</td><td>{word()}</td></tr></table>"])

    def attr(kind: str, sure: bool = False) -> str:
        if style not in ("semantic", "marked") or not sure and rng.random() < 0.25:
            return rng.choice(["", "", f' id="{word()}"', f' class="{word()} c{rng.randint(1, 9)}"'])
        if rng.random() < 0.15:
            return f' class="{word()}{rng.randint(1, 9)}"'
        tokens = rng.choice(TOKENS[kind].split())
        if rng.random() < 0.3:
            tokens += rng.choice(["-", " ", "_"]) + rng.choice([word(), "wrap", "box", "inner"])
        return f' {rng.choice(["class", "class", "id"])}="{tokens}"'

    def links(n: int) -> str:
        items = [f'<a href="/{word()}">{" ".join(word() for _ in range(rng.randint(1, 4)))}</a>' for _ in range(n)]
        return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if rng.random() < 0.6 else rng.choice([" | ", " ", ""]).join(items)

    def boiler(kind: str) -> str:
        names, body = {
            "menu": ("nav div", lambda: links(rng.randint(2, 9))),
            "head": ("header div", lambda: f"<a href='/'>{sentence(2)}</a>" + rng.choice(["", f"<p>{sentence(5)}</p>", links(4), f"<h1>{sentence(2)}</h1>"])),
            "foot": ("footer div", lambda: rng.choice(["&copy; ", "", "© 2024 "]) + word() + rng.choice([" &middot; ", " - ", " ", ", "]) + " ".join(sentence() for _ in range(rng.randint(1, 3))) + rng.choice(["", links(3)])),
            "side": ("aside div", lambda: rng.choice([f"<h3>{sentence(2)}</h3>", ""]) + rng.choice([links(5), links(3) + sentence(), f"<p>{sentence()}</p>" * 2])),
            "note": ("div", lambda: f"{sentence()} {sentence()}" + rng.choice(["", "<button>Ok</button>", f'<a href="/p">{word()}</a>'])),
            "ad": ("div aside section", lambda: rng.choice([sentence(), f"{sentence()} {sentence()}", f'<a href="http://x">{sentence()}</a>', f"<p>{sentence()}</p>"])),
            "form": ("form", lambda: f"<label>{sentence(3)}</label><input name='q'>" + rng.choice(["", f"<p>{sentence()}</p>"]) + f"<button>{word()}</button>"),
            "reply": ("div section", lambda: f"<h3>{sentence(2)}</h3>" + "".join(f"<div{attr('reply')}><b>{word()}</b> <p>{sentence()} {sentence()}</p></div>" for _ in range(rng.randint(1, 5)))),
            "share": ("div", lambda: links(rng.randint(2, 4))),
        }[kind]
        names = names.split()
        name = names[0] if style != "marked" and rng.random() < 0.7 else "form" if kind == "form" else "div" if style != "semantic" else rng.choice(names)
        plain = name in ("div", "section") and kind not in ("menu", "share")
        return f'<{name}{attr(kind, plain)} data-k="0">{body()}</{name}>'

    some = lambda *kinds: "".join(boiler(k) for k in kinds if rng.random() < 0.5)
    title = sentence(rng.randint(1, 9))
    if style == "fragment":
        n = rng.choice([1, 1, 2, 3, 6])
        kind = rng.choice(["p", "p", "text", "br", "div", "page"])
        bits = [" ".join(sentence() for _ in range(rng.choice([1, 2, 5]))) for _ in range(n)]
        body = {"p": "".join(para() for _ in range(n)), "text": " ".join(bits), "br": "<br>".join(bits), "div": "".join(f"<div>{x}</div>" for x in bits), "page": f"<html><head><title>{title}</title></head><body>{''.join(para() for _ in range(n))}</body></html>"}[kind]
        return rng.choice(["", "", f"<h1>{title}</h1>"] if kind != "page" else [""]) + body, True
    least = 1 if style in ("semantic", "marked") else 2
    paras = [para(least) for _ in range(rng.choice([1, 1, 2, 3, 5, 9, 16] if least == 1 else [2, 3, 5, 9, 16]))]
    if rng.random() < 0.3 and least == 1:
        paras.insert(rng.randint(0, len(paras)), boiler(rng.choice(["ad", "share", "side", "form", "note"])))
    head = rng.choice([f"<h1>{title}</h1>", f"<h1>{title}</h1>", "", f"<header><h1>{title}</h1></header>"])
    top, bottom = some("note", "head", "menu", "ad", "menu"), some("form", "ad", "side") + some("foot", "foot")
    page = lambda body: f"<html><head><title>{title}</title><style>p{{}}</style><script>var a=1;</script></head><body>{body}</body></html>"
    if style == "table":
        side = f'<td data-k="0">{rng.choice([links(rng.randint(2, 9)), boiler("side")])}</td>'
        core = f'<td data-k="1">{head}{"".join(paras)}</td>'
        return page(f"{top}<table><tr>{rng.choice([side + core, core + side, core])}</tr></table>{bottom}"), False
    name = {"semantic": ["article", "article", "main", "section"], "marked": ["div", "div", "section"], "bare": ["div", "div", "div", "section"]}[style]
    if style == "bare" and rng.random() < 0.2:  # paragraphs without anything around them
        inner = "".join(f'<p data-k="1">{" ".join(sentence() for _ in range(rng.randint(2, 8)))}</p>' for _ in paras)
    else:
        name = rng.choice(name)
        inner = f'<{name}{attr("main", style == "marked")} data-k="1">{head}{"".join(paras)}</{name}>'
    inner += some("reply", "side", "share") if least == 1 else ""
    for _ in range(rng.choice([0, 0, 1, 2])):
        around = rng.choice(["", f' class="{rng.choice([word(), "wrap", "page", "row", "container", "layout"])}"'])
        inner = f'<{rng.choice(["div", "main", "section"]) if style != "bare" else "div"}{around}>{some("side", "note")}{inner}</div>'
    return page(top + inner + bottom), False


def labels(dom: Dom, whole: bool = False) -> list[int]:
    """Of an invented page's nodes: 1 for main text, 0 for boilerplate, by the nearest mark above; -1 for what holds both."""
    label = [1 if whole else -1] * len(dom.tag)
    for i in range(1, len(label)):
        label[i] = 0 if dom.tag[i] in UNSEEN else int(dom.mark[i]) if dom.mark[i] else label[dom.parent[i]]
    return label


def fit_pages(pages: int = 900, seed: int = 1) -> Boosted:
    """Trees fitted on invented pages, on the nodes that hold text of one kind."""
    rng, xs, ys = random.Random(seed), [], []
    for _ in range(pages):
        page, whole = made_page(rng)
        dom = Dom(page)
        label, x = labels(dom, whole), features(dom)
        seen = [i for i in range(len(label)) if label[i] >= 0 and x[i, FEATURES.index("log_chars")] > 0]
        xs.append(x[seen])
        ys.append(np.array([label[i] for i in seen], float))
    return Boosted.fit(np.concatenate(xs), np.concatenate(ys))


def extract_all(pages: list[str], model: Boosted) -> list[str]:
    doms = [Dom(p) for p in pages]
    xs = [features(d) for d in doms]
    odds = np.split(model.scores(np.concatenate(xs)), np.cumsum([len(x) for x in xs])[:-1]) if xs else []
    return [main_text(d, decode(d, o)) for d, o in zip(doms, odds, strict=True)]


def extract_pages(df: DataFrame, model: Boosted | None = None) -> DataFrame:
    """page_id, url, text and n_chars for every row of df (page_id, url, html).

    Null html counts as empty; a page without main text has the empty text. Repeated rows get a row
    each; other columns are ignored; an empty table gives no rows. Nothing is shuffled. Pages of any length are
    read whole; of equally probable assignments the one with more main text is taken.
    """
    batched(df.sparkSession)
    model = model or fit_pages()
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pages = b.column(2).to_pylist()
            found = [t for lo in range(0, len(pages), 50) for t in extract_all(pages[lo : lo + 50], model)]
            yield record(schema, b.column(0), b.column(1), found, [len(t) for t in found])

    return df.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).mapInArrow(freed(run), "page_id long, url string, text string, n_chars long")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
