"""Rule sets: what counts as non-content, as plain values on the driver."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from pathlib import Path

# These patterns, colours, style names and identifiers define the results and must stay as they are, in this order.
SPECIFIER_PATTERNS = (
    r"\[specifier[:\s].*?\]",
    r"\[note to specifier\]",
    r"note to specifier[:\s]",
    r"\[specifier note\]",
    r"\[edit.*?note.*?\]",
    r"\[coordinator.*?note.*?\]",
    r"<specifier.*?>",
    r"^\s*\*\*\*.*?\*\*\*\s*$",
    r"\[verify\s+.*?\]",
    r"\[coordinate\s+.*?\]",
    r"\[confirm\s+.*?\]",
)
SIGNAL_COLORS = ("FF0000", "C00000", "0000FF", "0070C0")
COPYRIGHT_PATTERNS = (
    r"©",
    r"copyright\s+\d{4}",
    r"copyright\s+©",
    r"all\s+rights\s+reserved",
    r"may\s+not\s+be\s+reproduced",
    r"proprietary\s+information",
    r"licensed\s+for\s+use\s+by",
    r"duplication.*?prohibited",
    r"unauthorized.*?reproduction",
)
VENDOR_PATTERNS = (
    r"specagent\.com",
    r"specagent",
    r"spec\s*agent",
    r"www\.specagent",
    r"produced\s+by\s+specagent",
    r"generated\s+by\s+specagent",
)
EDITORIAL_PATTERNS = (
    r"retain\s+or\s+delete",
    r"delete\s+if\s+not\s+(applicable|required|used)",
    r"retain\s+if\s+(applicable|required|used)",
    r"select\s+one",
    r"choose\s+one",
    r"delete\s+options?\s+not\s+(applicable|required|selected)",
    r"revise\s+as\s+required",
    r"edit\s+as\s+required",
    r"modify\s+as\s+required",
    r"coordinate\s+with\s+(architect|engineer|owner)",
    r"<insert\s*.*?>",
    r"\[insert\s*.*?\]",
    r"\{insert\s*.*?\}",
    r"<enter\s*.*?>",
    r"\[enter\s*.*?\]",
    r"\[\s*\]",
    r"<\s*>",
    r"\[_+\]",
    r"<_+>",
    r"\[\.\.+\]",
    r"delete\s+this\s+(paragraph|section|line)",
    r"remove\s+this\s+(paragraph|section|line)",
    r"to\s+be\s+determined",
    r"\[tbd\]",
    r"\[n/a\]",
    r"\[pending\]",
    r"fill\s+in\s+(the\s+)?blank",
    r"complete\s+this\s+section",
    r"verify\s+(with|before)\s+",
    r"---+\s*optional\s*---+",
    r"===+\s*optional\s*===+",
    r"\*{3,}\s*optional\s*\*{3,}",
    r"^\s*\.\s*\d+\s*$",
    r"optional\s+paragraph",
    r"alternate\s+paragraph",
)
PRESERVE_PATTERNS = (
    r"^\s*end\s+of\s+section",
    r"^\s*section\s+\d{4,}",
    r"^\s*part\s+\d+\s*[-–—:]",
    r"^\s*article\s+\d+\s*[-–—:]",
)
PARAGRAPH_STYLES = ("CMT", "SpecifierNote", "Specifier Note", "EditorNote", "Editor Note", "EditorialNote", "NotetoSpecifier", "CoordinatorNote")
CHARACTER_STYLES = ("SpecifierNote", "Specifier Note", "EditorNote", "Hidden")
PROTECTED_STYLES = (
    "Normal", "DefaultParagraphFont", "TableNormal", "NoList",
    "Heading1", "Heading2", "Heading3", "Heading4", "Heading5", "Heading6", "Heading7", "Heading8", "Heading9",
    "Title", "Subtitle", "ListParagraph", "TOCHeading", "TOC1", "TOC2", "TOC3", "TOC4", "TOC5",
    "Header", "Footer", "FootnoteText", "EndnoteText", "CommentText", "BalloonText", "Hyperlink",
)
ALWAYS_USED_STYLES = ("Normal", "DefaultParagraphFont", "TableNormal", "NoList")
RUN_CONTENT_TAGS = ("t", "drawing", "pict", "sym", "tab", "br", "cr", "fldChar", "instrText", "object", "ruby")
COMPAT_SCAN_TAGS = ("compatSetting", "useFELayout", "useWord2002TableStyleRules", "growAutofit", "useWord97LineBreakRules")
COMPAT_CLEAN_TAGS = (
    *COMPAT_SCAN_TAGS,
    "doNotUseIndentAsNumberingTabStop", "useAltKinsokuLineBreakRules", "allowSpaceOfSameStyleInTable", "doNotSuppressParagraphBorders",
    "doNotAutofitConstrainedTables", "autofitToFirstFixedWidthCell", "displayHangulFixedWidth", "splitPgBreakAndParaMark",
    "doNotVertAlignCellWithSp", "doNotBreakConstrainedForcedTable", "doNotVertAlignInTxbx", "useAnsiKerningPairs", "cachedColBalance",
)
COMPAT_KEPT_NAME = "overrideTableStyleFontSizeAndJustification"
BOOKMARK_PREFIXES = ("_GoBack", "_Ref", "_Toc", "_Hlk", "_PictureBullets")
KEPT_SCRIPTS = ("latin", "ea", "cs")
KEYWORDS = ("retain", "delete", "verify", "coordinate", "revise", "edit", "specifier", "architect", "section title", "project-specific", "inserting text", "subparagraph below")
RSID_SCAN = r'\bw:rsid[A-Za-z]*\s*=\s*"[^"]*"'
RSID_STRIP = r'\s+w:rsid[A-Za-z]*="[^"]*"'
SAVED_BYTES = {"link": 200, "style": 500, "rsid": 25, "empty": 20, "font": 60, "compat": 50, "bookmark": 80, "proof": 40}
# End of fixed values.

SECTIONS = ("specifier_notes", "copyright_notices", "hidden_text", "specagent_references", "editorial_artifacts", "preserve_patterns")
CONTENT_TYPES = ("specifier_note", "copyright", "hidden_text", "specagent", "editorial_artifact", "preserve")


@dataclass(frozen=True)
class Section:
    """One section of a rule set; a section that a configuration leaves out is enabled and empty."""

    enabled: bool = True
    patterns: tuple[str, ...] = ()


@dataclass(frozen=True)
class Rules:
    sections: Mapping[str, Section] = field(default_factory=dict)
    colors: tuple[str, ...] = ()
    styles: tuple[str, ...] = ()

    def section(self, name: str) -> Section:
        return self.sections.get(name, Section())


DEFAULT = Rules(
    dict(zip(SECTIONS, (Section(patterns=p) for p in (SPECIFIER_PATTERNS, COPYRIGHT_PATTERNS, (), VENDOR_PATTERNS, EDITORIAL_PATTERNS, PRESERVE_PATTERNS)), strict=True)),
    SIGNAL_COLORS,
    PARAGRAPH_STYLES + CHARACTER_STYLES,
)


def from_config(config: Mapping) -> Rules:
    """Rules of a parsed configuration; both style lists serve paragraphs and runs alike."""
    sections = {name: Section(bool(part.get("enabled", True)), tuple(part.get("text_patterns") or ())) for name in SECTIONS if (part := config.get(name)) is not None}
    signals = (config.get("specifier_notes") or {}).get("formatting_signals") or {}
    styles = config.get("style_based_detection") or {}
    return Rules(sections, tuple(signals.get("colors") or ()), (*(styles.get("paragraph_styles") or ()), *(styles.get("character_styles") or ())))


def load(path: str | Path) -> Rules:
    import yaml

    return from_config(yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {})
