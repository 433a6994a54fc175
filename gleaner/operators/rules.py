"""Line-rule packs and HTML exclusions per host, as data.

Fixed values: every word list, pattern and selector below decides which lines
and elements survive, so they are stated as they must be matched.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class RulePack:
    """How the markdown lines of one host are cleaned; unused rules stay empty.

    A page is read line by line: nothing before ``start_pattern`` on URLs
    holding ``start_in_url``, nothing from the first stop line on, no dropped
    lines; ``rewrites`` change the whole text first, ``line_rewrites`` each
    line between the two rounds of dropping.
    """

    host: str
    rewrites: tuple[tuple[str, str], ...] = ()
    start_in_url: str = ""
    start_pattern: str = ""
    start_emits: str = ""
    stop_headings: tuple[str, ...] = ()
    stop_headings_by_prefix: bool = False
    stop_lines: tuple[str, ...] = ()
    stop_patterns: tuple[str, ...] = ()
    drop_first: tuple[str, ...] = ()
    line_rewrites: tuple[tuple[str, str], ...] = ()
    drop_last: tuple[str, ...] = ()
    drop_headings: tuple[str, ...] = ()
    drop_lines: tuple[str, ...] = ()
    drop_prefixes: tuple[str, ...] = ()
    drop_stripped: tuple[str, ...] = ()
    trim_line_ends: bool = False
    one_cell_per_line: bool = False
    cut_from_last: str = ""


SPACE_BEFORE_MARK = (r"\s+([,;:])", "$1")
ONLY_A_LINK = r"^\s*\[[^\]]+\]\([^)]+\)\s*$"

ENCYCLOPEDIA = RulePack(
    host="it.wikipedia.org",
    stop_headings=(
        "collegamenti esterni",
        "note",
        "riferimenti",
        "bibliografia",
        "fonti",
        "altri progetti",
        "voci correlate",
    ),
    drop_first=(
        r"(?i)^\[vai al\b",
        r"(?i)^\[salta al?\b",
        r"(?i)^\[modifica?\b",
        r"^\s*!\[",
    ),
    line_rewrites=(
        (r"\[(?:\d{1,3}|N\s*\d+)\]", ""),
        (r"\[([^\]]*)\]\([^()]*(?:\([^()]*\)[^()]*)*\)", "$1"),
        SPACE_BEFORE_MARK,
    ),
    drop_last=(r"^\s*!\[",),
)

NEWS = RulePack(
    host="www.cnbc.com",
    stop_headings=(
        "related content",
        "more from cnbc",
        "trending now",
        "you may also like",
        "watch now",
        "sign up",
        "watch live",
        "more in",
        "sponsored content",
        "advertisement",
    ),
    stop_headings_by_prefix=True,
    line_rewrites=(
        (r"\*{1,3}\s*\*{1,3}", ""),
        SPACE_BEFORE_MARK,
    ),
    drop_last=(
        r"(?i)choose cnbc",
        r"(?i)follow us on",
        r"(?i)subscribe to cnbc",
        r"(?i)^\[(?:photo|video|image|watch)[^\]]*\]\s*$",
        ONLY_A_LINK,
        r"(?i)^read (more|also)\s*:",
        r"(?i)^\**\s*WATCH\s*:\**",
        r"(?i)^\[Sign up\]\(",
        r"(?i)cnbc's new online course",
    ),
    cut_from_last=r"(?i)^[*_]*\s*Want to\b",
)

SPORTS = RulePack(
    host="www.espn.com",
    start_in_url="/player/stats/",
    start_pattern=r"(?i)^#+\s*Stats\s*$|^Stats\s*$",
    start_emits="Stats",
    stop_headings=(
        "advertisement",
        "trending",
        "top stories",
        "more from espn",
        "related content",
        "you may also like",
        "related stories",
        "editors' picks",
    ),
    stop_headings_by_prefix=True,
    stop_patterns=(
        r"(?i)terms of use",
        r"(?i)privacy policy",
        r"(?i)cookie policy",
        r"(?i)interest.based ads",
        r"(?i)eu privacy rights",
        r"(?i)manage privacy preferences",
        r"(?i)espn enterprises",
        r"(?i)all rights reserved",
    ),
    drop_first=(
        r"(?i)^\**\s*(WATCH|READ)\s*:\**",
        ONLY_A_LINK,
        r"^\s*\**-\s*(?:[^\[\n]*:\s*)?\[[^\]]+\]\([^)]+\)\**\s*$",
        r"(?i)follow us on",
        r"^\s*\*[^*]+\*\s*$",
        r"(?i)^BESbswy",
    ),
)

FINANCE = RulePack(
    host="www.xe.com",
    rewrites=(
        (r"\*\* +([,.;:!?)])", "**$1"),
        (r"(?i)!\[[^\]]*\]\([^)]*logo-xe[^)]*\)", ""),
        (r"!\[([^\]]*)\]\([^)]*\)", "$1"),
        (r"(\S)(\[[^\]]+\]\([^)]*\))", "$1\n$2"),
        (r"([a-z])([A-Z])", "$1 $2"),
    ),
    stop_headings=(
        "related articles",
        "related posts",
        "you may also like",
        "sign up",
        "get started",
        "popular currencies",
        "xe is trusted by millions around the globe",
        "send money destinations",
        "international money transfers done right",
    ),
    stop_lines=(
        "send money destinations",
        "xe is trusted by millions around the globe",
        "trusted by",
        "loading popular currency pairs...",
    ),
    drop_headings=("compare and save",),
    drop_lines=(
        "did you know you can send money abroad with xe?",
        "add currency",
    ),
    drop_prefixes=(
        "we use the mid-market rate",
        "when you compare xe to leading banks",
        "the comparison savings are based on",
    ),
    drop_stripped=(
        r"^\*\s*\*\s*\*[\s*]*$|^-{3,}$|^_{3,}$",
        r"^\|?\s*:?-{2,}:?\s*(?:\|\s*:?-{2,}:?\s*)+\|?$",
        r"(?i)\[\s*Speak to an FX specialist",
        r"(?i)\[\s*Download the Global Currency Outlook",
    ),
    trim_line_ends=True,
    one_cell_per_line=True,
)

RULE_PACKS = (ENCYCLOPEDIA, NEWS, SPORTS, FINANCE)


@dataclass(frozen=True)
class Exclusion:
    """Elements to leave out: a tag ('' for any) and (attribute, test, value) conditions.

    Tests: ``=`` equal, ``word`` one of the space-separated words, ``in`` part
    of the value, ``end`` its end.
    """

    tag: str = ""
    conditions: tuple[tuple[str, str, str], ...] = ()


def _ids(*names: str) -> tuple[Exclusion, ...]:
    return tuple(Exclusion(conditions=(("id", "=", n),)) for n in names)


def _classes(*names: str, tag: str = "") -> tuple[Exclusion, ...]:
    return tuple(Exclusion(tag, (("class", "word", n),)) for n in names)


def _class_parts(*parts: str, tag: str = "") -> tuple[Exclusion, ...]:
    return tuple(Exclusion(tag, (("class", "in", p),)) for p in parts)


@dataclass(frozen=True)
class HtmlFilter:
    """What is removed from a host's HTML before it becomes markdown."""

    host: str
    tags: tuple[str, ...] = ()
    exclusions: tuple[Exclusion, ...] = ()
    remove_forms: bool = True


CODE_TAGS = ("style", "script", "link", "meta", "noscript")

HTML_FILTERS = (
    HtmlFilter(
        host="it.wikipedia.org",
        tags=(*CODE_TAGS, "nav"),
        exclusions=(
            *_classes("vector-header-container"),
            *_ids("siteNotice", "p-search", "p-lang-btn"),
            *_classes("vector-page-toolbar"),
            *_ids("siteSub"),
            *_classes("infobox", "sinottico"),
            Exclusion("figcaption"),
            *_classes("itwiki-template-citazione-footer"),
            *_classes("mw-highlight-copy-button", "mw-editsection"),
            *_classes("ambox", "metadata", "thumbcaption"),
        ),
    ),
    HtmlFilter(
        host="www.cnbc.com",
        tags=CODE_TAGS,
        exclusions=(
            *_ids("GlobalNavigation", "MakeItGlobalNavigation"),
            *_class_parts(
                "CNBCGlobalNav",
                "nav-menu-",
                "account-menu",
                "SignInMenu",
                "SignUpMenu",
                "JumpLink",
                "WatchLive",
            ),
            *_ids("onetrust-consent-sdk", "onetrust-banner-sdk", "onetrust-pc-sdk"),
            *_classes("otFlat", "ot-iab-2"),
            *_class_parts(
                "ArticleHeader-eyebrow",
                "ArticleHeader-time",
                "Author-author",
                "ArticleHeader-authorAndShareInline",
                "ArticleHeader-styles-makeit-time",
                "ArticleHeader-styles-makeit-authorAndShare",
                "InlineVideo",
                "PlaceHolder-wrapper",
                "InlineImage-styles-makeit-imageEmbed",
                "InlineImage-imageEmbed",
            ),
            *_classes("RelatedQuotes-relatedQuotes", "QuoteInBody-inlineButton"),
            *_class_parts(
                "googlePreferredSourceContainer", "PageHeaderWithTuneInText", "RelatedStories"
            ),
            Exclusion(conditions=(("id", "in", "RelatedStories"),)),
            Exclusion(conditions=(("id", "in", "RelatedVideo"),)),
            *_class_parts("RelatedContent-styles-makeit-relatedContent"),
            *_classes("RelatedContent-relatedContent", "social-buttons-transporter"),
            *_class_parts("TransporterSection", "SectionWrapper"),
            *_classes(
                "Collapsible-proliveCollapsableContainer",
                "InteractiveChart-container",
                "InteractiveChart-caption",
            ),
            *_ids("GlobalFooter"),
            *_class_parts("CNBCFooter", "MakeItFooter-styles-makeit-container"),
        ),
    ),
    HtmlFilter(
        host="www.espn.com",
        tags=(*CODE_TAGS, "img"),
        exclusions=(
            *_ids(
                "header-wrapper",
                "global-header",
                "global-scoreboard",
                "global-nav",
                "global-nav-mobile-trigger",
            ),
            *_classes("sidebar"),
            *_ids("news-feed-content", "news-feed"),
            *_classes(
                "article-meta",
                "byline-wrap",
                "byline-measured",
                "byline-authors",
                "author-overlay",
                "timestamp",
                "content-reactions",
                "share-button-wrapper",
                "share-popup",
                "content-reactions-extended-wrapper",
            ),
            *_classes("inline", "inline-photo", "inline-track", "editorial", "float-r", tag="aside"),
            *_classes(
                "article-footer", "article-legal-footer", "foot-content", "page-select", "controls"
            ),
            *_ids("footer"),
            *_classes("StatsTable__Filters", "ot-sdk-container"),
            *_ids("onetrust-consent-sdk", "onetrust-button-group-parent"),
            *_classes("ot-cat-grp", "WebPlayerContainer", "video-play-button", "contentItem__content"),
            Exclusion("figcaption"),
        ),
    ),
    HtmlFilter(
        host="www.xe.com",
        tags=(*CODE_TAGS, "footer", "nav"),
        exclusions=(
            *_ids("siteHeader"),
            *_class_parts("fixed inset-x-0", "border-[#ccc]", tag="div"),
            Exclusion("img", (("alt", "=", "heading picture"),)),
            *_class_parts("mb-8 mt-6 flex items-center", "rounded-xl bg-gray-250", tag="div"),
            Exclusion("a", (("href", "in", "account.xe.com"),)),
            *_class_parts("polymorphic-btn"),
            *_class_parts("flex flex-wrap gap-2", tag="div"),
            *_class_parts("py-12", tag="section"),
            Exclusion("div", (("data-testid", "=", "trusted-by"),)),
            Exclusion("div", (("data-testid", "=", "trustpilot-newcore"),)),
            Exclusion("span", (("id", "end", "-aria-description"),)),
            Exclusion("div", (("data-testid", "=", "timestamp-template"),)),
            Exclusion("div", (("class", "in", "mb-24"), ("class", "in", "from-blue-900"))),
            *_class_parts("animate-slideFromLeft", tag="div"),
            Exclusion("svg", (("aria-label", "=", "Xe"),)),
        ),
    ),
)
