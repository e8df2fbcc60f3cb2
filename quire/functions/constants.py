"""Fixed values that have to be exactly these for results to be right."""

# --- fixed values: navigation candidates, in order, with their weights --------------------------------
TOC_CANDIDATES = [
    ("nav.sidebar a", 0.95),
    ("aside nav a", 0.90),
    (".toc a", 0.85),
    (".sidebar a", 0.80),
    (".nav-links a", 0.75),
    (".menu a", 0.70),
    (".tree a", 0.70),
    ("nav ul a", 0.65),
    (".navigation a", 0.60),
    ("#toc a", 0.60),
]

# --- fixed values: content-region candidates, in order; "body" when none matches ----------------------
CONTENT_CANDIDATES = [
    "article.markdown-body",
    ".markdown-body",
    "article.doc-content",
    "article",
    ".content",
    ".post-content",
    ".article-content",
    ".entry-content",
    "main",
    "[role='main']",
    ".main",
    "#content",
    "#main",
]

# --- fixed values: selectors of navigation that is folded up -------------------------------------------
COLLAPSED_SELECTORS = [
    "button[aria-expanded='false']",
    ".collapse-toggle:not(.open)",
    ".expand-button:not(.expanded)",
    "[data-toggle='collapse']:not(.collapsed)",
    ".sidebar-group:not(.open) > .sidebar-heading",
    ".nav-link[aria-expanded='false']",
    ".vp-sidebar-group:not(.open) .caret",
    ".menu__list-item--collapsed .menu__link--sublist",
    ".theme-doc-sidebar-item-collapsed .menu__link--sublist",
    "[data-expanded='false']",
    ".arrow:not(.down)",
    ".caret:not(.open)",
    ".chevron:not(.rotated)",
    "details:not([open]) > summary",
    ".nav-item.collapsed > .nav-link",
    ".folder:not(.open) > .folder-toggle",
    ".toc-item:not(.expanded) .toc-toggle",
    ".tree-item:not(.open) .tree-toggle",
]

# --- fixed values: fewest links a navigation candidate must match -------------------------------------
MIN_TOC_LINKS = 3

# --- fixed values: elements removed before conversion, and attributes stripped before that ------------
PRUNED_TAGS = ["script", "style", "nav", "header", "footer", "aside"]
AD_CLASSES = ["ad", "advertisement"]
STRIPPED_ATTRIBUTES = ["class", "id", "style", "data-*"]

# --- fixed values: code-fence languages that are kept -------------------------------------------------
FENCE_LANGUAGES = [
    "go", "python", "javascript", "js", "typescript", "ts", "java", "c", "cpp", "csharp", "cs", "ruby",
    "rust", "php", "swift", "kotlin", "scala", "html", "css", "sql", "bash", "shell", "sh", "json",
    "yaml", "xml", "markdown", "md",
]

# --- fixed values: page labels that are noise in a converted text --------------------------------------
NOISE_LABELS = ["本页总览", "页面总览"]
CONTENTS_LABEL = "目录"

# --- fixed values: names used when there is nothing better -----------------------------------------------
UNTITLED_DOCUMENT = "未命名文档"
UNTITLED_FILE = "untitled"

# --- fixed values: file names ---------------------------------------------------------------------------
UNSAFE_FILE_CHARACTERS = '/\\:*?"<>|'
MAX_FILE_NAME_BYTES = 100
INDEX_FILE = "index.md"

# --- fixed values: layout of times in written files -----------------------------------------------------
TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"

# --- fixed values: lines and items shown in a preview ---------------------------------------------------
PREVIEW_LINES = 50
PREVIEW_ITEMS = 10

# --- fixed values: white space as Unicode defines it, in code-point order -------------------------------
UNICODE_SPACE = (
    r"\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)

# --- fixed values: HTML element classes (HTML Living Standard) ---------------------------------------------
VOID_TAGS = [
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source",
    "track", "wbr",
]
RAW_TEXT_TAGS = ["script", "style"]
# elements that hold text only: markup inside them is not markup
TEXT_TAGS = ["iframe", "noembed", "noframes", "noscript", "textarea", "title", "xmp"]
INLINE_TAGS = [
    "a", "abbr", "b", "bdi", "bdo", "big", "button", "cite", "code", "data", "del", "dfn", "em", "font",
    "i", "ins", "kbd", "label", "mark", "nobr", "q", "s", "samp", "small", "span", "strike", "strong",
    "sub", "sup", "time", "tt", "u", "var",
]
BLOCK_TAGS = [
    "address", "article", "aside", "blockquote", "body", "center", "details", "dialog", "dir", "div",
    "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
    "head", "header", "hgroup", "html", "main", "menu", "nav", "ol", "pre", "section", "summary",
    "table", "tbody", "tfoot", "thead", "ul",
]
# elements whose end tag may be left out -> rank; one ends where another of the same or a lower rank
# starts or ends beside it (and a paragraph also where a block starts)
OPTIONAL_END_RANK = {
    "tr": 1, "td": 2, "th": 2, "li": 2, "dt": 2, "dd": 2, "option": 2, "optgroup": 1, "p": 3,
}
