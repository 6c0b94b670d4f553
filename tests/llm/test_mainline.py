import pytest

from flowloom.llm import mainline as M

PROSE = "A long paragraph of prose that is well above the threshold, as it has a good many words in it."


@pytest.mark.parametrize(
    "page, text",
    [
        ("", ""),
        ("no markup and short", ""),
        (f"<p>{PROSE}", PROSE),
        (f"<nav><ul><li><a href=x>Home</a></ul></nav><article><h1>T &amp; U</h1><p>one<br>two  \n three</article><footer>&copy; {PROSE}</footer>", "T & U one two three"),
        (f"<body><div class='cookie-notice'>{PROSE}</div><div id=main-content><p>{PROSE}<p>Short.</div><aside>{PROSE}</aside>", f"{PROSE} Short."),
        (f"<article><p>{PROSE}</p><div class=ad>{PROSE}</div><p>end</p><section id=comments><p>{PROSE}</section></article>", f"{PROSE} end"),
        (f"<script>var t='</p>{PROSE}';</script><style>{PROSE}</style><!-- {PROSE} --><main>kept</main>", "kept"),
        ("<article>3 &lt; 4 and x < y, hi<i>th</i>ere<b", "3 < 4 and x < y, hithere"),
        (f"<nav>never closed<article>{PROSE}</article>", PROSE),
        (f"<form><input>{PROSE}<button>Go</button></form><p hidden>{PROSE}</p><p style='display:none'>{PROSE}", ""),
        ("<ul><li><a href=a>" + "</a><li><a href=b>".join([PROSE] * 3) + "</a></ul>", ""),
        ("<article>a b&nbsp;c &am</article>", "a b c &am"),
    ],
)
def test_pages(page, text):
    assert M.main_text(page) == text


def test_broken_pages_take_linear_time():
    for piece in ('<a href="', "<!--", "<div>", "<script>", "<nav>", "&", "<"):
        M.main_text(piece * 30_000)


def test_frame(spark):
    pages = spark.createDataFrame(
        [(1, "u", f"<article>{PROSE}</article>", "x", 1), (None, None, None, None, None), (2, "v", "", "x", 2), (1, "u", f"<article>{PROSE}</article>", "x", 1)],
        "page_id long, url string, html string, text string, n_chars int",
    )
    rows = sorted(M.extract(pages).collect(), key=lambda r: (r.page_id or 0, r.text))
    assert [(r.page_id, r.url, r.text, r.n_chars) for r in rows] == [
        (None, None, "", 0), (1, "u", PROSE, len(PROSE)), (1, "u", PROSE, len(PROSE)), (2, "v", "", 0)
    ]
    assert M.extract(pages.limit(0)).collect() == []
