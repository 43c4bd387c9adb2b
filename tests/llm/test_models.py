"""The quality classifier against a plain fit, and main texts of pages written by hand."""

import math

import numpy as np
from pyspark.sql import functions as F

from storyline.llm import html, quality
from storyline.llm import queries as q

DATA = "/root/testdata/sf0.001"


def plain_isotonic(score, label):
    """Each value is the largest, over the places before it, of the least mean label up to a place after it."""
    order = np.argsort(score, kind="stable")
    s, y = score[order], label[order]
    total = np.concatenate([[0], np.cumsum(y)])
    mean = lambda j, k: (total[k + 1] - total[j]) / (k + 1 - j)
    rise = [round(max(min(mean(j, k) for k in range(i, len(y))) for j in range(i + 1)), 12) for i in range(len(y))]
    at, says = [], []
    for value in sorted(set(rise)):
        pool = [i for i in range(len(y)) if rise[i] == value]
        at.append(s[pool].mean())
        says.append((y[pool].sum() + 0.5 * y.mean()) / (len(pool) + 0.5))
    return at, says


def test_quality_equals_a_plain_fit(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    known = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect() if r.doc_id in docs}
    said = {r.doc_id: r for r in spark.createDataFrame([(i,) for i in docs], "doc_id long").select("doc_id", quality.held_out(F.col("doc_id")).alias("out"), (F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0).alias("aside")).collect()}
    learn = [i for i in known if not said[i].out]
    x = np.array([quality.statistics(docs[i] or "") for i in learn])
    y = np.array([known[i] for i in learn], float)
    mean, scale = x.mean(0), x.std(0) + 1e-6
    r = np.random.default_rng(quality.SEED)
    weights = r.standard_normal((x.shape[1], quality.FOURIER)) / math.sqrt(2 * x.shape[1])
    shift = r.uniform(0, 2 * math.pi, quality.FOURIER)

    def features(x):
        z = np.clip((x - mean) / scale, -8, 8)
        return np.array([[1.0, *(math.sqrt(2 / quality.FOURIER) * np.cos(row @ weights + shift)), *row] for row in z])

    aside = np.array([said[i].aside for i in learn])
    a = features(x[~aside])
    # Ridge as least squares with further rows.
    more = math.sqrt(quality.RIDGE * len(a)) * np.eye(a.shape[1])
    ridge = np.linalg.lstsq(np.vstack([a, more]), np.concatenate([y[~aside], np.zeros(a.shape[1])]), rcond=None)[0]
    at, says = plain_isotonic(features(x[aside]) @ ridge, y[aside])
    raw = features(np.array([quality.statistics(t or "") for t in docs.values()])) @ ridge
    want = np.clip(0.998 * np.interp(raw, at, says) + 0.002 * np.clip(raw, 0, 1), 0, 1)
    got = {r.doc_id: r.score for r in q.op8_quality(spark, DATA).collect()}
    assert len(aside) > aside.sum() > 5
    assert max(abs(got[i] - w) for i, w in zip(docs, want, strict=True)) < 1e-6


P = [
    "The ferry left the island at dawn and nobody on deck spoke, for the night had been long and the sea was still high.",
    "By noon the wind had turned, and the captain ordered the crew to shorten sail before the squall that he saw in the west.",
    "They reached the harbour in the evening, tired and wet, and the innkeeper gave them soup and a place beside the fire.",
]
MENU = '<ul><li><a href="/">Home</a></li><li><a href="/news">News</a></li><li><a href="/about">About us</a></li><li><a href="/contact">Contact</a></li></ul>'
FOOT = "<p>Copyright 2024 Island Press. All rights reserved. <a href='/terms'>Terms</a> | <a href='/privacy'>Privacy</a></p>"
PAGES = [
    f"<html><head><title>x</title></head><body><nav>{MENU}</nav><main><h1>The crossing</h1><p>{P[0]}</p><p>{P[1]}</p><p>{P[2]}</p></main><footer>{FOOT}</footer></body></html>",
    f'<html><body><div class="topnav">{MENU}</div><div id="content"><h2>The crossing</h2><p>{P[0]}</p><p>{P[1]}</p><p>{P[2]}</p></div><div id="sidebar"><h3>Related</h3>{MENU}</div><div class="footer">{FOOT}</div></body></html>',
    f'<html><body><header><form action="/s"><input name="q"><button>Search</button></form>{MENU}</header><section class="story"><p>{P[0]}</p><blockquote><p>{P[1]}</p></blockquote><p>{P[2]}</p></section><div class="comments"><p>Nice story!</p><p>I was there too.</p></div><footer>{FOOT}</footer></body></html>',
    f'<html><body><div class="cookie-banner"><p>We use cookies to improve your visit.</p><button>Accept</button></div><div class="wrap"><div class="post-body"><p>{P[0]}</p><ul><li>{P[1]}</li><li>{P[2]}</li></ul></div><div class="ad"><p>Buy our new boots today!</p></div></div></body></html>',
]
WANT = [["The crossing", *P], ["The crossing", *P], P, P]


def test_main_text_of_pages_written_by_hand(spark):
    """Shapes that no template has. Sentences of the article must be there, and those around it must not, in most of them: the
    share of blocks that are rightly kept or dropped is at least 0.75."""
    df = spark.createDataFrame(list(enumerate(PAGES)), "page_id long, html string").withColumn("url", F.lit("u"))
    got = {r.page_id: r.text for r in html.extract(df).collect()}
    around = ["About us", "All rights reserved", "Nice story!", "cookies", "boots", "Search", "Related"]
    right = total = 0
    for k, page in enumerate(PAGES):
        for block in WANT[k]:
            right, total = right + (block in got[k]), total + 1
        for word in around:
            if word in page:
                right, total = right + (word not in got[k]), total + 1
    assert right >= 0.75 * total, (right, total, got)
