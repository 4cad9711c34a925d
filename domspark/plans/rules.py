"""What the tree builder knows about tags, as tables.

A tag belongs to classes. From them follow: which start tags end an open element (YIELDS), what a start tag closes and implies before it is put
into the tree (OPENING), and what an end tag closes (CLOSING). A step of a program is (verb, what, reach):

* shut  - close open elements up to and with the innermost `what`, if there is one within reach;
* grow  - open an implied element `what` within the innermost element of the class or name `reach`, unless there is one already;
* must  - like shut, but an end tag without a match is an error (which is told as the name in `what`);
* halt  - the rest only holds if `what` is within reach; if it isn't, the end tag is treated as an ordinary one.

Reaches: FAR is the whole stack above the fragment's context, TABLE the innermost table, SELECT the innermost select.
"""

from __future__ import annotations

from functools import lru_cache

from domspark.functions.text import fold
from domspark.options import Options

FAR, IN_TABLE, IN_SELECT = "far", "table", "select"
SHUT, GROW, MUST, HALT = "shut", "grow", "must", "halt"
CELL, SECTION, OWN = "CELL", "SECTION", "OWN"  # names are folded, so these can't be tags

# The tag classes of the tree rules. Those of the first table are told by the tag as it is spelled, the others in any case.
SPELLED = {
    "head content": "base basefont bgsound link meta noframes noscript script style template title",
    SECTION: "tbody tfoot thead",
    CELL: "td th",
    "table part": "caption col colgroup table tbody td tfoot th thead",
    "formatting": "a b big code em font i nobr s small strike strong tt u",
    "block": "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hgroup hr main nav ol p pre section table ul",
    "end optional": "body caption colgroup dd dt head html li optgroup option p rb rp rt rtc tbody td tfoot th thead tr",
    "paragraph": "p",
    "item": "li",
    "term": "dd dt",
}
ANY_CASE = {"row": "tr", "table": "table", "button": "button"}

#: Classes of an innermost element -> classes of the start tags that end it.
YIELDS = {
    "paragraph": ("block",),
    "item": ("item",),
    "term": ("term",),
    "button": ("button",),
    CELL: (CELL, "row", SECTION),
    "row": ("row", "table", SECTION),
    SECTION: (SECTION, "table"),
}

_OUT_OF_ROWS = ((SHUT, CELL, IN_TABLE), (SHUT, "tr", FAR), (SHUT, SECTION, IN_TABLE))
_OUT_OF_HEADING = ((SHUT, "caption", FAR), (SHUT, "colgroup", FAR))
_ROW_ENDS = ((SHUT, CELL, IN_TABLE), (SHUT, "tr", IN_TABLE))
_OPTION, _GROUP = (SHUT, "option", IN_SELECT), (SHUT, "optgroup", IN_SELECT)

#: By name or class: steps before a start tag is put into the tree.
OPENING = {
    "caption": (*_OUT_OF_ROWS, (SHUT, "colgroup", FAR), (SHUT, "caption", FAR)),
    "colgroup": (*_OUT_OF_ROWS, (SHUT, "caption", FAR), (SHUT, "colgroup", FAR)),
    "col": (*_OUT_OF_ROWS, (SHUT, "caption", FAR), (GROW, "colgroup", "table")),
    SECTION: _OUT_OF_HEADING,
    "tr": (*_OUT_OF_HEADING, (GROW, "tbody", "table")),
    CELL: (*_OUT_OF_HEADING, (GROW, "tbody", "table"), (GROW, "tr", SECTION)),
    "option": (_OPTION,),
    "optgroup": (_OPTION, _GROUP),
    "select": (_OPTION, _GROUP, (SHUT, "select", IN_SELECT)),
}
#: By name or class: steps of an end tag. Tags that aren't here end the innermost element of their name.
CLOSING = {
    CELL: ((HALT, OWN, FAR), (MUST, OWN, FAR)),
    "caption": ((MUST, OWN, FAR),),
    "colgroup": ((MUST, OWN, FAR),),
    "tr": ((SHUT, CELL, IN_TABLE), (MUST, "tr", IN_TABLE)),
    SECTION: (*_ROW_ENDS, (MUST, OWN, FAR)),
    "table": (*_OUT_OF_HEADING, *_ROW_ENDS, (SHUT, SECTION, IN_TABLE), (MUST, "table", FAR)),
    "option": ((MUST, "option", IN_SELECT),),
    "optgroup": (_OPTION, (MUST, "optgroup", IN_SELECT)),
    "select": (_OPTION, _GROUP, (MUST, "select", IN_SELECT)),
}
_ENDS_MOVED = frozenset(("caption", "colgroup", "tr", "table", CELL, SECTION))  # end tags before which moved elements close
_SELECT_PARTS = frozenset(("option", "optgroup", "select"))


class Rule:
    """All that holds for a tag; made once for each spelling of a tag."""

    __slots__ = ("tag", "low", "void", "kinds", "yields", "part", "holds_parts", "head", "formatting", "optional", "keys", "opening", "select_opening", "closing", "ends_moved", "plain", "plain_end", "strict")

    def __init__(self, tag: str, void: bool):
        self.tag, self.low, self.void = tag, fold(tag), void
        kinds = {k for k, tags in SPELLED.items() if tag in tags.split()} | {k for k, tags in ANY_CASE.items() if self.low in tags.split()}
        self.kinds = frozenset(kinds)
        self.yields = frozenset(x for k in kinds for x in YIELDS.get(k, ()))
        self.part = "table part" in kinds or "row" in kinds
        self.holds_parts = "table" in kinds or "row" in kinds or SECTION in kinds
        self.head, self.formatting, self.optional = "head content" in kinds, "formatting" in kinds, "end optional" in kinds
        self.keys = (self.low, *(k for k in (CELL, SECTION) if k in kinds))
        programs = [k for k in (self.low, CELL, SECTION) if k == self.low or k in kinds]
        named = lambda table: next((table[k] for k in programs if k in table), ())
        own = tuple((verb, self.low if what == OWN else what, reach) for verb, what, reach in named(CLOSING))
        self.closing, self.ends_moved = own, any(k in _ENDS_MOVED for k in programs)
        steps = named(OPENING)
        self.opening, self.select_opening = ((), steps) if self.low in _SELECT_PARTS else (steps, ())
        self.strict = self.holds_parts or self.low == "colgroup"  # not just anything may stand in it
        shell = self.low in ("html", "head", "body")
        # Nothing but the innermost element decides on plain tags.
        self.plain_end = not (own or shell or void)
        self.plain = not (steps or self.part or self.head or self.low in ("html", "head", "body", "form", "a", "br", "svg", "math", "col"))


@lru_cache(maxsize=4096)
def _rule(tag: str, void: bool) -> Rule:
    return Rule(tag, void)


class Rules(dict):
    """tag -> Rule under given options."""

    def __init__(self, options: Options):
        super().__init__()
        self._options = options

    def __missing__(self, tag: str) -> Rule:
        rule = _rule(tag, self._options.is_void(tag))
        if len(self) < 4096:  # pages may make up names without end
            self[tag] = rule
        return rule


@lru_cache(maxsize=32)
def rules(options: Options) -> Rules:
    return Rules(options)
