"""Metadata and main text of web pages, and parts of mails, with the standard library in Arrow batches."""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator
from email import message_from_bytes, policy
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

LEAST_TEXT = 600
MOST_BLOCKS = 400
# What is not text, what closes itself, where articles stand and where dates are told.
DROPPED = {"script", "style", "noscript", "iframe", "form", "nav", "header", "footer", "aside", "button", "svg"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
ARTICLE_GROUPS = (
    (("tag", "article"),),
    (("itemprop", "articleBody"),),
    (("class", "article-body"), ("class", "articleBody"), ("id", "article-body"), ("id", "articleBody")),
    (("class", "press-release"), ("class", "pressrelease"), ("class", "pr-body"), ("id", "release-body")),
    (("class", "entry-content"), ("class", "content__body"), ("class", "story-body"), ("class", "post-content")),
    (("class", "gnw-article"), ("class", "gnw-press-release"), ("class", "release-body"), ("class", "release-content"), ("class", "news-release")),
)
DATE_META = ("article:published_time", "datePublished", "parsely-pub-date", "pubdate", "date")
DATELINE = re.compile(r"([A-Za-z]{3,9}\s+\d{1,2},\s+\d{4})\s+(\d{1,2}:\d{2})\s*(AM|PM)?\s*(ET|CEST|CET|UTC|GMT|BST)?")


def _is(tag: str, a: dict, group: tuple) -> bool:
    """Whether an element is one of a group of ARTICLE_GROUPS."""
    return any((kind == "tag" and tag == v) or (kind != "tag" and v in a.get(kind, "").split()) for kind, v in group)


class _Page(HTMLParser):
    """One pass: open blocks gather text, and whatever tells company or time is noted."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, dict]] = []
        self.blocks: list[tuple[str, dict, list[str]]] = []
        self.open: list[tuple[int, list[str]]] = []
        self.plain = 0
        self.all: list[str] = []
        self.title: list[str] = []
        self.meta: list[tuple[str, str]] = []
        self.times: list[str] = []
        self.linked: list[str] = []

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag == "meta":
            self.meta.append((a.get("property") or a.get("itemprop") or a.get("name") or "", a.get("content", "")))
        if tag == "time" and a.get("datetime"):
            self.times.append(a["datetime"])
        if tag in VOID:
            return
        self.stack.append((tag, a))
        plain = tag in ("div", "section")
        self.plain += plain
        if plain and self.plain <= MOST_BLOCKS or any(_is(tag, a, group) for group in ARTICLE_GROUPS):
            text: list[str] = []
            self.blocks.append((tag, a, text))
            self.open.append((len(self.stack), text))

    def handle_endtag(self, tag):
        if tag in VOID or tag not in (t for t, _ in self.stack):
            return
        while self.stack:
            depth = len(self.stack)
            top, _ = self.stack.pop()
            if self.open and self.open[-1][0] == depth:
                self.open.pop()
            if top == tag:
                break

    def handle_data(self, data):
        names = [t for t, _ in self.stack]
        if "script" in names and any(t == "script" and a.get("type") == "application/ld+json" for t, a in self.stack):
            self.linked.append(data)
        text = data.strip()
        if not text:
            return
        if "title" in names:
            self.title.append(text)
        if not DROPPED.intersection(names):
            self.all.append(text)
            for _, block in self.open:
                block.append(text)


def parse(page: str) -> _Page:
    p = _Page()
    p.feed(page or "")
    p.close()
    return p


def main_text(page: str) -> str:
    """The first article-like block with enough text, else the longest block."""
    p = parse(page)
    for group in ARTICLE_GROUPS:
        for tag, a, text in p.blocks:
            if _is(tag, a, group):
                joined = "\n".join(text)
                if len(joined) >= LEAST_TEXT:
                    return joined
                break
    blocks = ["\n".join(text) for tag, _, text in p.blocks if tag in ("div", "section")][:MOST_BLOCKS]
    return max(blocks, key=len, default="") or "\n".join(p.all)


def page_meta(page: str) -> dict:
    """title, company_name and release_time_text: linked data, then meta tags, then <time>, then the dateline, then `Source:`."""
    p = parse(page)
    company = time = None
    for blob in p.linked:
        try:
            nodes = json.loads(blob)
        except ValueError:
            continue
        for node in nodes if isinstance(nodes, list) else [nodes]:
            if isinstance(node, dict):
                time = time or node.get("datePublished") or node.get("dateCreated")
                for k in ("sourceOrganization", "publisher", "author"):
                    if isinstance(node.get(k), dict) and node[k].get("name"):
                        company = company or node[k]["name"].strip()
    for name in DATE_META:
        time = time or next((v for k, v in p.meta if k == name and v), None)
    time = time or next(iter(p.times), None)
    head = " ".join(p.all)[:1500]
    line = DATELINE.search(head)
    if not time and line:
        time = " ".join(x for x in line.groups() if x)
    source = re.search(r"\bSource:\s*([^|]+)", head, re.I)
    if not company and source:
        company = source[1].strip().rstrip("·|")
    if not company and "NEWS PROVIDED BY" in head.upper():
        after = head[head.upper().index("NEWS PROVIDED BY") + 16 :].strip()
        company = after.split("  ")[0][:80] or None
    return {"title": " ".join(p.title) or None, "company_name": company, "release_time_text": time}


def strip_tags(text: str) -> str:
    """Visible text of a fragment, white space collapsed."""
    return re.sub(r"\s+", " ", " ".join(parse(text).all)).strip() if "<" in (text or "") else html.unescape(text or "").strip()


def pages(df: DataFrame, key: str = "page_id", page: str = "html") -> DataFrame:
    """(key, title, company_name, release_time_text, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [page_meta(p or "") | {"text": main_text(p or "")} for p in batch.column(1).to_pylist()]
            names = ["title", "company_name", "release_time_text", "text"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[n] for r in rows], pa.string()) for n in names)], names=[key, *names])

    return df.select(key, page).mapInArrow(run, f"`{key}` {dict(df.dtypes)[key]}, title string, company_name string, release_time_text string, text string")


def mail_body(raw: bytes) -> tuple[str, str, str]:
    """(subject, sender, text): plain text preferred, HTML as fallback, attachments skipped."""
    m = message_from_bytes(raw, policy=policy.default)
    plain = marked = None
    for part in m.walk():
        if part.is_multipart() or part.get_content_disposition() == "attachment":
            continue
        if part.get_content_type() == "text/plain" and plain is None:
            plain = part.get_content()
        if part.get_content_type() == "text/html" and marked is None:
            marked = part.get_content()
    return m.get("subject", ""), m.get("from", ""), (plain or strip_tags(marked or "")).strip()


def mails(df: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Messages of a binaryFile source as (path, subject, sender, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [mail_body(raw or b"") for raw in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], pa.string()) for i in range(3))], names=["path", "subject", "sender", "text"])

    return df.select(path, content).mapInArrow(run, "path string, subject string, sender string, text string")
