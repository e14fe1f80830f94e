"""Main text of web pages: a linear-chain conditional random field over leaf blocks, decoded by Viterbi.

The library has no page records of its own; the operator is general (page_id, url, html).
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwake.llm import tables

BLOCKS = set("address article aside blockquote body br dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li "
             "main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul video".split())
VOID = set("area base br col embed hr img input link meta source track wbr".split())
HIDDEN = ("script", "style", "noscript", "template", "svg", "iframe", "textarea", "title", "head", "button", "select", "option")
# A quote opens an attribute's value only after "="; a tag that never ends takes the rest of the page. No part of the pattern is tried twice.
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<(/?)([a-zA-Z][^\s/>]*+)((?>[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]*+))*+)(?:>|\Z)|<[!?][^>]*>", re.S)
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
CHROME = {"nav": ("nav", "menu", "breadcrumb", "toolbar", "pagination", "pager"), "ad": ("ad", "ads", "advert", "advertisement", "banner", "sponsor", "sponsored", "promo"),
          "side": ("sidebar", "aside", "related", "widget", "share", "social", "complementary"), "note": ("cookie", "consent", "notice", "newsletter", "subscribe", "popup", "modal", "alert"),
          "talk": ("comment", "comments", "discussion", "replies", "reply", "respond", "disqus"), "foot": ("footer", "copyright", "legal", "contentinfo", "colophon"),
          "head": ("header", "masthead", "topbar"), "form": ("form", "login", "search", "signup")}
GOOD = ("content", "article", "main", "post", "entry", "story", "body", "text")
ANCESTORS = ("article", "main", "section", "nav", "footer", "header", "aside", "form", "ul", "li", "table", "p", "h1", "h2", "div", "a")
NAMED = [*(f"tag:{t}" for t in ANCESTORS), *(f"kind:{k}" for k in CHROME), "kind:good", "short", "long", "ends", "links", "upper", "copyright", "nowhere", "bias"]
INDEX = {n: i for i, n in enumerate(NAMED)}


def leaf_blocks(page: str) -> list[tuple[str, list[int]]]:
    """Text and feature numbers of every leaf block in page order; white space is folded, references are decoded."""
    stack: list[tuple[str, frozenset]] = []
    out, buf, linked, pos = [], [], 0, 0

    def flush() -> None:
        nonlocal buf, linked
        text = " ".join(entities.unescape("".join(buf)).split())
        if text:
            tags = {t for t, _ in stack}
            f = [INDEX[f"tag:{t}"] for t in ANCESTORS if t in tags]
            kinds = frozenset().union(*(k for _, k in stack)) if stack else frozenset()
            f += [INDEX[f"kind:{k}"] for k in kinds]
            n = len(text)
            f += [INDEX["short"]] * (n < 30) + [INDEX["long"]] * (n > 120) + [INDEX["ends"]] * (text[-1] in ".!?") + [INDEX["links"]] * (linked * 2 > n)
            f += [INDEX["upper"]] * (text.isupper()) + [INDEX["copyright"]] * ("©" in text) + [INDEX["nowhere"]] * (not kinds and not tags & {"article", "main", "p"}) + [INDEX["bias"]]
            out.append((text, f))
        buf, linked = [], 0

    hidden = 0

    def text(s: str) -> None:
        nonlocal linked
        if s and not hidden:
            buf.append(s)
            if any(t == "a" for t, _ in stack):
                linked += len(s)

    end = len(page)
    while pos < end:
        m = TOKEN.search(page, pos)
        if m is None:
            text(page[pos:])
            break
        text(page[pos:m.start()])
        pos = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if tag in BLOCKS:
            flush()
        if m[1]:
            if any(t == tag for t, _ in stack):
                while stack:
                    t, _ = stack.pop()
                    hidden -= t in HIDDEN
                    if t == tag:
                        break
            continue
        if tag in VOID or m[3].endswith("/"):
            continue
        if tag == "p" or tag == "li":  # an open p or li ends where the next begins
            while stack and stack[-1][0] in (tag, "b", "i", "em", "strong", "span", "a") and any(t == tag for t, _ in stack[-4:]):
                t, _ = stack.pop()
                if t == tag:
                    break
        names = {w for x in NAMES.findall(m[3]) for w in re.split(r"[^a-z0-9]+", "".join(x).lower())}
        kinds = {k for k, words in CHROME.items() if names & set(words)} | ({"good"} if names & set(GOOD) else set())
        stack.append((tag, frozenset(kinds)))
        hidden += tag in HIDDEN
        if tag in ("script", "style", "textarea", "title", "noscript"):
            close = re.compile(f"</{tag}", re.I).search(page, pos)
            pos = close.start() if close else end
    flush()
    return out


class PageTagger:
    """Weights of the field: features by label, label pairs."""

    def __init__(self):
        self.w, self.t = np.zeros((len(NAMED), 2)), np.zeros((2, 2))

    def emit(self, feats: list[list[int]]) -> np.ndarray:
        return np.array([self.w[f].sum(0) for f in feats])

    def viterbi(self, e: np.ndarray) -> list[int]:
        back, s = [], e[0]
        for x in e[1:]:
            m = s[:, None] + self.t
            back.append(m.argmax(0))
            s = m.max(0) + x
        y = [int(s.argmax())]
        for b in reversed(back):
            y.append(int(b[y[-1]]))
        return y[::-1]

    def gradient(self, feats, y) -> tuple[np.ndarray, np.ndarray]:
        """Observed minus expected counts, by forward and backward sums."""
        e, n = self.emit(feats), len(feats)
        a, b = np.zeros((n, 2)), np.zeros((n, 2))
        a[0] = e[0]
        for i in range(1, n):
            a[i] = e[i] + np.logaddexp.reduce(a[i - 1][:, None] + self.t, axis=0)
        for i in range(n - 2, -1, -1):
            b[i] = np.logaddexp.reduce(self.t + (e[i + 1] + b[i + 1])[None], axis=1)
        z = np.logaddexp.reduce(a[-1])
        gw, gt, p = np.zeros_like(self.w), np.zeros_like(self.t), np.exp(a + b - z)
        for i, f in enumerate(feats):
            np.add.at(gw[:, y[i]], f, 1)
            for k in (0, 1):
                np.add.at(gw[:, k], f, -p[i, k])
            if i:
                gt[y[i - 1], y[i]] += 1
                gt -= np.exp(a[i - 1][:, None] + self.t + (e[i] + b[i])[None] - z)
        return gw, gt

    def fit(self, pages: list[tuple[list, list[int]]], rounds: int = 150, rate: float = 0.3, decay: float = 0.002) -> PageTagger:
        for _ in range(rounds):
            for feats, y in pages:
                gw, gt = self.gradient(feats, y)
                self.w += rate * (gw - decay * self.w)
                self.t += rate * (gt - decay * self.t)
        return self


#: Pages labelled by hand for training: main text stands between «», one string per page layout.
LABELLED = (
    '<body><nav><ul><li><a href="/">Home</a></li><li><a>Reports</a></li></ul></nav><div class="ad">Buy paint for your hull today.</div><article><h1>«Slick north of the port»</h1><p>«A slick was seen at dawn, and two vessels were near it for several hours before.»<p>«It drifted to the east with the wind during the day and reached open water by night.»</p></article><footer>&copy; Coast desk</footer></body>',
    '<body><header><a>Coast news</a></header><div class="cookie-notice">We use cookies to make this site work for you.</div><div id="content"><h2>«Inspection report»</h2><p>«The tanker was held for two days while the harbour master read its oil record book.»</p><p>«Short.»</p><div class="comments"><p>Great report, thank you for writing this up so well.</p><p>I do not agree with this at all.</p></div></div><div class="sidebar"><h3>Related</h3><p>Another long story about ships that you may like to read next week.</p></div><footer><p>All rights reserved by the coast desk and its owners.</p></footer></body>',
    '<body><div class="menu"><a>One</a><a>Two</a></div><main><section><p>«Winds were weak and the current set to the south for most of the following night.»</p><aside><p>Sign up for our letter and hear from us every single morning of the week.</p></aside><ul><li>«first point»</li><li>«second point of the list, which is a little longer»</li></ul><form><p>Leave your address here.</p></form></section></main><div class="footer">Contact us</div></body>',
    '<body><div class="post-body"><h1>«NOTICE TO SHIPS»</h1><p>«ALL!! SHIPS!! STAY!! CLEAR!!»</p><br>«of the area until further word»<table><tr><td>«one»</td><td>«two»</td></tr></table></div><div class="advert"><p>Cheap fuel for every captain, only this week and only in our own shop.</p></div><section class="comments"><p>First comment here.</p></section></body>',
    '<body><nav><a>Start</a></nav><article><h1>«Title»</h1><p>«One.»</p><p>«Two words»</p><p>«A third paragraph with | bars | and ### marks *** in it»</p></article><div class="ad"><p>Another advert with many words in it, and a full stop at its end.</p></div><footer>&copy; m.example &middot; Words of an owner. And more.</footer></body>',
    '<body><header><h1>Site name</h1><p>The best site for news of the sea and of all who sail it.</p></header><p>«A page without any article tag at all, only paragraphs one after the other.»</p><p>«The second one follows it here.»</p><div class="share">Share this</div><footer><p>Imprint of this site and everything that the law asks for.</p></footer></body>',
    '<body><nav><a>Start</a></nav><div class="ad">Only adverts on this page.</div><footer>&copy; nobody</footer></body>',
)


def train_tagger(pages: tuple[str, ...] = LABELLED) -> PageTagger:
    data = []
    for p in pages:
        plain = leaf_blocks(p.replace("«", "").replace("»", ""))  # the marks must not reach the features
        if plain:
            data.append(([f for _, f in plain], [int("«" in t) for t, _ in leaf_blocks(p)]))
    return PageTagger().fit(data)


def main_text(pages: DataFrame, tagger: PageTagger | None = None, html: str = "html") -> DataFrame:
    """Adds text (main blocks in page order, joined by a blank) and n_chars to pages.

    Null, empty and unparsable html give the empty text; the whole page is read, nothing is dropped for length. Other
    columns pass through, those of the result's names are replaced; repeated rows repeat the answer.
    """
    shared = tables.Shared(pages, tagger or train_tagger())

    @F.pandas_udf("string")
    def extract(col: pd.Series) -> pd.Series:
        def one(page: str | None) -> str:
            found = leaf_blocks(page or "")
            if not found:
                return ""
            y = shared.value.viterbi(shared.value.emit([f for _, f in found]))
            return " ".join(t for (t, _), k in zip(found, y, strict=True) if k)

        return col.map(one)

    d = pages.withColumn("_t", extract(F.coalesce(F.col(html), F.lit(""))))
    return d.drop("text", "n_chars").withColumn("text", F.col("_t")).withColumn("n_chars", F.length("_t").cast("long")).drop("_t")
