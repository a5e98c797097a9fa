import pytest

from aerolith.llm import html_text


@pytest.mark.parametrize("icon", ['<svg viewBox="0 0 1 1"/>', "<svg>", "<math display=block />", "<svg><path d='M0'><title/>", "<svg><title>x", "<template>", "<noscript>", "<iframe src=a>", "<iframe />", "<svg><g><path d='M0'/></g></svg>"])
def test_no_text_is_lost_after_an_element_that_closes_itself_or_never_ends(icon):
    page = f"<body><div>{icon}<p>One two.</p><article><p>Three four.</p></article></div><p>Five.</p></body>"
    text = "".join(html_text.parsed(page).text)
    assert text.removeprefix("x") == "One two.Three four.Five."
    assert list(html_text.main_texts([page], None)) == ["One two. Three four. Five."]


def test_what_stands_in_such_elements_is_no_article_but_seen():
    page = "<p>One.</p><svg><text>label</text><style>a{}</style></svg><noscript><p>No script.</p></noscript><template><b>T</b></template><svg/><p>Two.</p><svg></svg><p>Three.</p>"
    t = html_text.parsed(page)
    assert {"label", "No script.", "T"} <= set(t.text)
    assert list(html_text.main_texts([page], None)) == ["One. Two. Three."]


def test_scripts_stay_raw():
    page = "<script>if (a < b) x = '<p>no</p>'</script><style>p > a {}</style><p>Yes.</p>"
    assert list(html_text.main_texts([page], None)) == ["Yes."]


def test_reading_takes_linear_time_whatever_the_markup():
    import time

    began = time.time()
    for bad in ('<a "', '<a ">" ', "<a '\"", "<!--<", "<p <", "<svg><g>", "</x>", "<td>", "<a b='"):
        html_text.parsed(bad * (300_000 // len(bad)))
    assert time.time() - began < 20
    assert "".join(html_text.parsed("a<b <i>c</i> \"d\" <p title='x>y'>e").text) == "ac \"d\" e"


def test_trees_find_the_article_by_shape_alone_on_pages_not_seen(sf_dir):
    import numpy as np
    import pyarrow.parquet as pq

    trees = [html_text.parsed(x) for x in pq.read_table(f"{sf_dir}/pages.parquet")["html"].to_pylist() if x]
    rows = [html_text.features(t)[0] for t in trees]
    marks = [html_text.labels(t, r) for t, r in zip(trees, rows)]
    told = [i for i, m in enumerate(marks) if m is not None]
    seen, away = told[::2], told[1::2]
    blank = [r.copy() for r in rows]
    for r in blank:
        r[:, html_text._TELLS] = 0
    model = html_text.fit(np.concatenate([rows[i] for i in seen] + [blank[i] for i in seen]), np.concatenate([marks[i] for i in seen] * 2))
    hit = got = want = 0
    for i in away:
        found, true = (html_text.text_of(trees[i], [True, *map(bool, k[1:])]).split() for k in (html_text.kept(trees[i], model.log_odds(blank[i])), marks[i]))
        hit, got, want = hit + len(set(found) & set(true)), got + len(set(found)), want + len(set(true))
    assert len(away) >= 20 and hit / want > 0.95 and hit / got > 0.95


def test_long_texts_count_capitals_like_short_ones():
    k = html_text.FEATURES.index("capitals")
    one, many = (html_text.features(html_text.parsed(f"<p>{'Abc ' * n}</p>"))[0][1, k] for n in (10, 1000))
    assert one == many > 0
