import pytest

from quire.functions import constants as K
from quire.operators import toc
from quire.plans.scan import scan_catalogs

PAGES = {
    0: "<nav class='sidebar'><ul><li><a href=/a>A</a><ul><li><a href=b>B</a></ul><li><a href='/c'> C </a></ul></nav><main>m</main>",
    1: "<div class=toc><a href=/1>1</a><a href=/2>2</a></div><div class=menu><a href=/1>1</a><a href=/2>2</a><a href=/3>3</a></div>",
    2: "<div class='menu tree'><a href=/1>1</a><a href=/2>2</a><a href=/3>3</a></div><div class=content>c</div>",
    3: "<div class=toc><a href=http://x/1>1</a><a href=http://y/2>2</a><a href=mailto:q>3</a></div>",
    4: "<div id=toc><a href=http://H/1>off</a><a href=http://h:8/2>port</a><a href=javascript:x>js</a><a href=''>empty</a>"
       "<a>none</a><a href=/6> </a><a href=/7>&lt;7&gt;</a></div><div role='main'>x</div>",
    5: "<ul><li><nav><ul><li><a href=/1>1</a><li><a href=/2>2</a><li><a href=/3>3</a></ul></nav></ul>",
    6: "",
    7: None,
}


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(i, f"http://h/d/p{i}", d) for i, d in PAGES.items()], "page_id long, url string, html string")


@pytest.fixture(scope="module")
def scanned(pages):
    catalogs, items = scan_catalogs(pages)
    return {r.page_id: r for r in catalogs.collect()}, items.orderBy("page_id", "idx").collect()


def test_best_selector(scanned):
    catalogs, _ = scanned
    got = {i: (r.selectors.toc, r.selectors.content, r.error) for i, r in catalogs.items()}
    assert got == {
        0: ("nav.sidebar a", "main", None),
        1: (".menu a", "body", None),  # two links are too few for .toc
        2: (".menu a", ".content", None),  # .tree scores the same, but comes later
        3: (None, "body", "toc_not_found"),
        4: ("#toc a", "[role='main']", None),
        5: ("nav ul a", "body", None),
        6: (None, "body", "toc_not_found"),
        7: (None, "body", "toc_not_found"),
    }
    assert {r.site for r in catalogs.values()} == {"h"} and not any(r.ai_generated for r in catalogs.values())


def test_confidence_counts_root_items_only(scanned):
    catalogs, _ = scanned
    assert catalogs[0].confidence == pytest.approx(3 * 0.95 / 3)
    assert catalogs[1].confidence == pytest.approx(3 * 0.70 / 4)
    # the link without a title counts for the score, but is no item
    assert catalogs[4].confidence == pytest.approx(3 * 0.60 / 3)
    # all levels are below a list around the page: no roots, an empty catalog
    assert catalogs[5].root_items == 0 and catalogs[5].confidence == 1.0


def test_items(scanned):
    _, items = scanned
    got = [(r.page_id, r.idx, r.parent_idx, r.depth, r.title, r.url) for r in items]
    assert [g for g in got if g[0] == 0] == [
        (0, 1, None, 1, "A", "http://h/a"), (0, 2, 1, 2, "B", "http://h/d/b"), (0, 3, None, 1, "C", "http://h/c"),
    ]
    assert [g[4:] for g in got if g[0] == 4] == [("port", "http://h:8/2"), ("<7>", "http://h/7")]
    assert not [g for g in got if g[0] in (3, 5, 6, 7)]


def test_scores_of_all_candidates(pages):
    got = {(r.page_id, r.selector): (r.links, r.valid_links) for r in toc.toc_scores(pages).collect()}
    assert got[(0, "nav.sidebar a")] == (3, 3) and got[(0, ".sidebar a")] == (3, 3) and got[(0, "nav ul a")] == (3, 3)
    assert got[(3, ".toc a")] == (3, 0)
    assert got[(4, "#toc a")] == (7, 3)
    assert (1, ".toc a") not in got


COLLAPSED = {
    "button[aria-expanded='false']": "<button aria-expanded='false'>", ".collapse-toggle:not(.open)": "<i class='collapse-toggle'>",
    ".expand-button:not(.expanded)": "<i class=expand-button>", "[data-toggle='collapse']:not(.collapsed)": "<i data-toggle='collapse'>",
    ".sidebar-group:not(.open) > .sidebar-heading": "<div class=sidebar-group><p class=sidebar-heading></p></div>",
    ".nav-link[aria-expanded='false']": "<a class=nav-link aria-expanded=false>",
    ".vp-sidebar-group:not(.open) .caret": "<div class=vp-sidebar-group><p><i class='caret open'></i></p></div>",
    ".menu__list-item--collapsed .menu__link--sublist": "<li class=menu__list-item--collapsed><a class=menu__link--sublist></a></li>",
    ".theme-doc-sidebar-item-collapsed .menu__link--sublist": "<li class=theme-doc-sidebar-item-collapsed><a class=menu__link--sublist></a></li>",
    "[data-expanded='false']": "<i data-expanded=false>", ".arrow:not(.down)": "<i class=arrow>", ".caret:not(.open)": "<i class=caret>",
    ".chevron:not(.rotated)": "<i class=chevron>", "details:not([open]) > summary": "<details><summary>s</summary></details>",
    ".nav-item.collapsed > .nav-link": "<li class='nav-item collapsed'><a class=nav-link></a></li>",
    ".folder:not(.open) > .folder-toggle": "<div class=folder><i class=folder-toggle></i></div>",
    ".toc-item:not(.expanded) .toc-toggle": "<div class=toc-item><i class=toc-toggle></i></div>",
    ".tree-item:not(.open) .tree-toggle": "<div class=tree-item><i class=tree-toggle></i></div>",
}


def test_collapsed_navigation(spark):
    assert list(COLLAPSED) == K.COLLAPSED_SELECTORS
    shut = list(COLLAPSED.values())
    opened = ["<details open><summary>s</summary></details>", "<div class='folder open'><i class=folder-toggle></i></div>",
              "<i class='arrow down'>", "<button aria-expanded=true>", "<div class='sidebar-group open'><p class=sidebar-heading></p></div>"]
    df = spark.createDataFrame(list(enumerate(shut + opened)), "page_id long, html string")
    got = {(r.page_id, r.selector): r.elements for r in toc.collapsed_nav(df).collect()}
    assert got == {(i, s): 1 for i, s in enumerate(COLLAPSED)}
