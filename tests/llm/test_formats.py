"""Chat reconstruction and page extraction."""

import math
import random
import time

import numpy as np
import pytest

from ledgerloom.llm import chat, tagpaths

LOG = "conv_id bigint, seq bigint, turn bigint, event string, role string, text string, p string, segments int"


def fold(events):
    """Turn -> (role, text), event by event."""
    turns: dict[int, list] = {}
    for _, turn, event, role, text in sorted(events, key=lambda e: (e[0], e[1], e[2], e[4] or "")):
        if event == "regenerate":
            for t in [t for t in turns if t >= turn]:
                del turns[t]
            turns[turn] = [role or "", text or ""]
        elif event == "edit":
            turns[turn] = [role or "", text or ""]
        elif event == "delta":
            turns.setdefault(turn, [role or "", ""])[1] += text or ""
    return [tuple(turns[t]) for t in sorted(turns)]


CONVERSATIONS = {
    1: [(1, 0, "delta", "user", "Hel"), (2, 0, "delta", "user", "lo"), (3, 1, "delta", "assistant", "a <|im_end|>\n"), (4, 1, "delta", "assistant", "b")],
    2: [(1, 0, "delta", "user", "q"), (2, 1, "delta", "assistant", "bad"), (3, 2, "delta", "user", "hm"), (4, 1, "regenerate", "assistant", None), (5, 1, "delta", "assistant", "good"), (6, 2, "delta", "user", "thanks")],
    3: [(5, 0, "edit", "user", "new"), (6, 0, "delta", "user", "er"), (1, 0, "delta", "user", "old"), (7, 0, "edit", "user", "last"), (2, 1, "delta", "assistant", "x")],
    4: [(1, 0, "delta", None, None), (2, 1, "unknown", "user", "no"), (3, 1, "delta", "a\nb %", "<\\\\| <| |> <\\ <")],
    None: [(1, 0, "delta", "assistant", "</s>[INST] ok [/INST]"), (1, 0, "delta", "assistant", "</s>[INST] ok [/INST]")],
}


def test_folding_and_round_trip(spark):
    rows = [(c, *e, "p", 1) for c, events in CONVERSATIONS.items() for e in events]
    log = spark.createDataFrame(rows, LOG)
    rendered = chat.render(chat.messages(log))
    read = rendered.select("conv_id", chat.parse(chat.formatted(rendered["segments"])).alias("t"), "segments").collect()
    assert {r.conv_id: [tuple(t) for t in r.t] for r in read} == {c: fold(e) for c, e in CONVERSATIONS.items()}
    for r in read:
        trained = [s.text for s in r.segments if s.loss]
        assert len(trained) == sum(role == "assistant" for role, _ in fold(CONVERSATIONS[r.conv_id]))
        assert all("<|" not in text for text in trained)


def test_native_plan(spark):
    log = spark.createDataFrame([(c, *e, "p", 1) for c, events in CONVERSATIONS.items() for e in events], LOG)
    plan = chat.digests(chat.render(chat.messages(log)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_repeated_and_null_turns_stay(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, "assistant", None), (1, 5, None, "z")]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = chat.digests(chat.render(chat.messages(chat.event_log(turns)))).collect()
    assert [(r.n_turns, r.loss_chars) for r in got] == [(4, 0)]
    none = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert chat.digests(chat.render(chat.messages(chat.event_log(none)))).collect() == []


PROSE = "A first sentence, of some length; it goes on and on. A second one, shorter."


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("", ""),
        ("plain   text\nonly", "plain text only"),
        (f"<nav>Home</nav><article><h1>Title</h1><p>{PROSE}</p><p>x</p></article><footer>(c)</footer>", f"Title\n{PROSE}\nx"),
        (f"<div class='menu'><p>{PROSE}</p></div><div id=c><h2>T</h2><p>{PROSE}<p>{PROSE}</div>", f"T\n{PROSE}\n{PROSE}"),
        (f"<main><p>{PROSE}</p><div class='comments'><p>{PROSE}</p></div><aside>{PROSE}</aside></main>", PROSE),
        ("<p>1 &lt; 2 &amp;&nbsp;3 <b>bold<i>er</b> x</p>", "1 < 2 & 3 bolder x"),
        (f"<script>if (a<b) '</p>'</script><style>p{{}}</style><p>{PROSE}</p><!-- {PROSE} -->", PROSE),
        (f"<body><div role=banner>hi</div><ul><li>one, two.<li>three, four.</ul><p>{PROSE}", f"one, two.\nthree, four.\n{PROSE}"),
        (f"<article><p>{PROSE}<br>next</p></article><p class=cookie-notice>{PROSE}</p>", f"{PROSE} next"),
        ("<p>cut off <a href='x", "cut off"),
    ],
)
def test_article_text(page, want):
    assert tagpaths.main_text(page) == want


LONG = " ".join([PROSE] * 3)


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<div class='{name}'><main><article><p>{LONG}</p></article></main></div>", LONG)
        for name in ("content-sidebar-wrap", "page no-sidebar", "has-nav", "layout search-enabled", "comments widget ad")
    ]
    + [
        (f"<body class=has-sidebar><div id=search-page><article><p>{PROSE}</p></article></div><div class=ad>{LONG[:60]}</div>", PROSE),
        (f"<div class='no-sidebar'><div class='has-nav'><p>{LONG}</p><p>{LONG}</p></div></div>", f"{LONG}\n{LONG}"),
        ("".join(f"<div class='el-widget el-text'><p>{PROSE}</p></div>" for _ in range(5)), "\n".join([PROSE] * 5)),
        (f"<div class=widget><p>{PROSE}</p></div><div class=notice><p>{PROSE}</p></div>", f"{PROSE}\n{PROSE}"),
        (f"<article><p>{LONG}</p></article><div id=comments><article class=comment><p>{PROSE}</p></article></div>", LONG),
        (f"<div class=ad>{LONG}</div><article><p>{PROSE}</p></article>", PROSE),
    ],
)
def test_marked_wrappers_keep_the_article(page, want):
    assert tagpaths.main_text(page) == want


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<body><main><article><p>{LONG}</p></article><article><p>{PROSE}</p></article></main>", f"{LONG}\n{PROSE}"),
        (f"<main><article><p>{LONG}</p></article><h2>Two</h2><section><p>{PROSE}</p></section></main>", f"{LONG}\nTwo\n{PROSE}"),
        (f"<body><article><p>{LONG}</p></article><article><p>{PROSE}</p></article><div class=ad>{PROSE}</div>", f"{LONG}\n{PROSE}"),
        (f"<body><div>{f'<p>{LONG}</p>' * 6}</div><div><p>{LONG}</p></div>", "\n".join([LONG] * 7)),
    ],
)
def test_split_articles_stay_whole(page, want):
    assert tagpaths.main_text(page) == want


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (
            f"<div class=top><a>Home</a> <a>News</a></div><div class=c><p>{LONG}</p></div><div class=c2><p>{LONG}</p></div>"
            "<div class=bottom>Copyright 2020 Foo.</div>",
            f"{LONG}\n{LONG}",
        ),
        (f"<body><ul><li><a>Home</a><li><a>News</a><li>About</ul><p>{LONG}</p><p>{LONG}</p>", f"{LONG}\n{LONG}"),
        (f"<body><h1>T</h1><p>{LONG}</p><h2>Part</h2><ul><li>one<li>two</ul><p>{LONG}</p>", f"T\n{LONG}\nPart\none\ntwo\n{LONG}"),
        (f"<div><p>{LONG}</p><ul><li><a>more</a></ul><p>{LONG} <a>link</a></p></div>", f"{LONG}\n{LONG} link"),
        (f"<div data-id='comment-1' title='id=ad'><p>{LONG}</p></div><div><p>{PROSE}</p></div>", f"{LONG}\n{PROSE}"),
        (f"<!--><p>{PROSE}</p><!-- x --!><p don't>{PROSE}</p>", f"{PROSE}\n{PROSE}"),
        (f"<p>{PROSE}</p><a href=\"x>never closed</a><p>gone</p>", PROSE),
    ],
)
def test_paths_below_the_threshold_are_dropped(page, want):
    assert tagpaths.main_text(page) == want


@pytest.mark.parametrize(
    "page",
    [
        "<div>" * 100_000 + "deep", "<a " * 100_000, "<p><li>" + "<h1>x" * 50_000, "<b></i>" * 50_000, "<p class=\"x" * 50_000,
        "<!-" * 100_000, "<script>" * 50_000, "<a href='" * 50_001, "<p x=" * 100_000, "<div class=ad>x" * 30_000,
    ],
)
def test_pages_are_read_in_linear_time(page):
    began = time.monotonic()
    tagpaths.main_text(page)
    assert time.monotonic() - began < 10


def test_scores_equal_plain_ratios():
    rng = random.Random(3)
    nodes = [(rng.choice(["a, b.", "long text; more of it, and more.", "x", "  "]), rng.randrange(5), 0, 0) for _ in range(60)]
    size = [len(n[0].strip()) for n in nodes]
    signs = [sum(c in tagpaths._PUNCTUATION for c in n[0]) for n in nodes]

    def ratio(values, path):
        here = [i for i, n in enumerate(nodes) if n[1] == path]
        return sum(values[i] for i in here) / max(1, sum(size[i] > 0 for i in here))

    def smooth(values):
        out = []
        for i in range(len(values)):
            near = [(j, math.exp(-((i - j) ** 2) / 2 / tagpaths.SPREAD**2)) for j in range(max(0, i - 2), min(len(values), i + 3))]
            out.append(sum(w * values[j] for j, w in near) / sum(w for _, w in near))
        return out

    near = smooth([ratio(size, n[1]) for n in nodes])
    fused = [a * b for a, b in zip(near, smooth([1 + ratio(signs, n[1]) for n in nodes]))]
    mean = sum(fused) / len(fused)
    bar = tagpaths.THRESHOLD * math.sqrt(sum((f - mean) ** 2 for f in fused) / len(fused))
    of_path = {p: [f for f, n in zip(fused, nodes) if n[1] == p] for p in range(5)}
    lent = {p: np.mean([v for v, n, s in zip(near, nodes, size) if n[1] == p and s]) for p in range(5)}
    content = {p for p, f in of_path.items() if sum(f) / len(f) >= bar and ratio(size, p) >= tagpaths.OWN * lent[p]}
    want = [f * s if n[1] in content else 0.0 for f, s, n in zip(fused, size, nodes)]
    np.testing.assert_allclose(tagpaths.content_scores(nodes), want)


def test_pages(spark):
    deep = "<div>" * 3000 + "deep" + "</div>" * 3000
    rows = [(1, "u", f"<p>{PROSE}</p>", "t"), (2, None, None, "t"), (None, "u", "", "t"), (3, "v", deep, "t"), (3, "v", deep, "t")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    got = sorted((tuple(r) for r in tagpaths.articles(pages).collect()), key=str)
    want = [(1, "u", PROSE, len(PROSE)), (2, None, "", 0), (None, "u", "", 0), (3, "v", "deep", 4), (3, "v", "deep", 4)]
    assert got == sorted(want, key=str)
    assert tagpaths.articles(spark.createDataFrame([], pages.schema)).collect() == []
