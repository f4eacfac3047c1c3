"""What a paragraph is, by its style: a convention given as data, and the ladder that reads it."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.names import folded, spaced

# Style identifiers and names of the word processor, and of the controlled styles.
ROLES = {
    "Heading1": ("heading", 1), "Heading2": ("heading", 2), "Heading3": ("heading", 3), "Heading4": ("heading", 4), "Heading5": ("heading", 5), "Heading6": ("heading", 6),
    "Normal": ("paragraph", None), "FootnoteText": ("paragraph", None), "EndnoteText": ("paragraph", None), "ListParagraph": ("paragraph", None),
    "Quote": ("prose_quote", None), "IntenseQuote": ("verse_quote", None), "Salutation": ("epigraph", None), "Signature": ("signature", None),
    "BlockText": ("floating_text", None), "Title": ("deferred", None), "Subtitle": ("deferred", None),
}
CONSECUTIVE_IDS, CONSECUTIVE_NAMES, NOT_CONSECUTIVE = ("BodyText",), ("corps de texte", "body text"), ("BodyText2", "BodyText3")
#: Styles of blocks that neighbours decide over, and of figures' texts.
CONTENTS = ("TOC1", "TOC2", "TOC3", "TOC4", "TOC5", "TOC6", "TOC7", "TOC8", "TOC9", "TOCHeading")
FIGURE_CONTAINERS = ("Normal", "FootnoteText", "EndnoteText")
CONTROLLED = {
    "TEIfiguretitle": "TEI_figure_title", "TEIfigurecaption": "TEI_figure_caption", "TEIfigurecredits": "TEI_figure_credits", "TEIcell": "TEI_cell",
    "TEIbiblstart": "TEI_bibl_start", "TEIbiblreference": "TEI_bibl_reference",
}
BIBLIOGRAPHY = ("Bibliography",)
CONTINUATION = ("ListParagraph",)
# Names that the word processor shows for its own styles in other languages, in lower case.
PARAGRAPH_NAMES = {
    "Heading1": ("heading 1", "titre 1", "überschrift 1", "título 1"),
    "Heading2": ("heading 2", "titre 2", "überschrift 2", "título 2"),
    "Heading3": ("heading 3", "titre 3", "überschrift 3", "título 3"),
    "Heading4": ("heading 4", "titre 4", "überschrift 4", "título 4"),
    "Heading5": ("heading 5", "titre 5", "überschrift 5", "título 5"),
    "Heading6": ("heading 6", "titre 6", "überschrift 6", "título 6"),
    "Normal": ("normal", "standard"),
    "BodyText": ("body text", "corps de texte", "textkörper", "texto independiente"),
    "Quote": ("quote", "citation", "zitat", "cita"),
    "IntenseQuote": ("intense quote", "citation intense"),
    "ListParagraph": ("list paragraph", "paragraphe de liste", "listenabsatz", "párrafo de lista"),
    "FootnoteText": ("footnote text", "note de bas de page", "fußnotentext", "texto de nota al pie"),
    "EndnoteText": ("endnote text", "note de fin", "endnotentext", "texto de nota al final"),
    "Title": ("title", "titre", "titel", "título"),
    "Subtitle": ("subtitle", "sous-titre", "untertitel", "subtítulo"),
    "Caption": ("caption", "légende", "beschriftung", "título de ilustración"),
    "Bibliography": ("bibliography", "bibliographie"),
}
CHARACTER_NAMES = {
    "Emphasis": ("emphasis", "accentuation", "énfasis"),
    "Strong": ("strong", "élevé"),
    "Hyperlink": ("hyperlink", "lien hypertexte"),
    "FollowedHyperlink": ("followedhyperlink", "followed hyperlink", "lien hypertexte suivi visité"),
    "FootnoteReference": ("footnote reference", "appel note de bas de p."),
    "EndnoteReference": ("endnote reference", "appel de note de fin"),
}
CHARACTER_MARKS = {"Strong": "bold", "Emphasis": "italic"}
NEUTRAL_CHARACTERS = ("Hyperlink", "FollowedHyperlink", "FootnoteReference", "EndnoteReference")
INLINE_REFERENCE = ("TEIbiblreference-inline", "TEI_bibl_reference-inline")


@dataclass(frozen=True)
class Convention:
    """Style id -> (role, heading level); pass another one to read documents of another house."""

    roles: dict[str, tuple[str, int | None]] = field(default_factory=lambda: dict(ROLES))
    consecutive_ids: tuple[str, ...] = CONSECUTIVE_IDS
    consecutive_names: tuple[str, ...] = CONSECUTIVE_NAMES
    not_consecutive: tuple[str, ...] = NOT_CONSECUTIVE

    def with_aliases(self, aliases: dict[str, str]) -> Convention:
        """`aliases`: a document's own style id -> the id it stands for; ids already known keep their role."""
        extra = {own: self.roles[meant] for own, meant in aliases.items() if meant in self.roles and own not in self.roles}
        return Convention(self.roles | extra, self.consecutive_ids + tuple(own for own, meant in aliases.items() if meant in self.consecutive_ids), self.consecutive_names, self.not_consecutive)


def consecutive(c: Convention, style: Column, name: Column, custom: Column) -> Column:
    """The built-in body text style, by id or by visible name."""
    known = style.isin(*c.consecutive_ids) | spaced(name).isin(*c.consecutive_names)
    return F.coalesce(known, F.lit(False)) & ~F.coalesce(custom, F.lit(False)) & ~F.coalesce(style.isin(*c.not_consecutive), F.lit(False))


def with_roles(paragraphs: DataFrame, c: Convention | None = None) -> DataFrame:
    """Adds role, level (of headings) and rendition.

    The first rule that holds decides: heading styles, the consecutive style, the other known styles, an
    outline level of 0 to 5, no style at all; anything else is unsupported.
    """
    c = c or Convention()
    style, outline = F.col("style_id"), F.col("outline_level")
    heads = [s for s, (role, _) in c.roles.items() if role == "heading"]
    names = F.create_map(*(F.lit(x) for s, (role, _) in c.roles.items() for x in (s, role)))
    levels = F.create_map(*(F.lit(x) for s in heads for x in (s, c.roles[s][1])))
    heading = F.coalesce(style.isin(*heads), F.lit(False))
    body = consecutive(c, style, F.col("style_name"), F.col("style_is_custom"))
    listed, outlined = names[style].isNotNull(), outline.between(0, 5)
    role = F.when(heading, "heading").when(body, "paragraph").when(listed, names[style]).when(outlined, "heading").when(style.isNull(), "paragraph").otherwise("unsupported")
    level = F.when(heading, levels[style]).when(body | listed, F.lit(None)).when(outlined, outline + 1)
    return paragraphs.withColumns({"role": role, "level": level.cast("int"), "rendition": F.when(body & ~heading, "consecutive")})


def own_styles(styles: DataFrame) -> DataFrame:
    """styles (pkg_id, style_id, name, style_type, is_custom) -> pkg_id, style_id, meant: ids that stand for the word processor's own styles by their visible names.

    Custom styles and ids that are known already stand for nothing else. The names are a fixed, small table.
    """
    known = [*PARAGRAPH_NAMES, *CHARACTER_NAMES]
    table = [("paragraph", own, n) for own, names in PARAGRAPH_NAMES.items() for n in names] + [("character", own, n) for own, names in CHARACTER_NAMES.items() for n in names]
    names = styles.sparkSession.createDataFrame(table, "_kind string, meant string, _name string").select("_kind", "meant", folded(F.col("_name")).alias("_fold"))
    kind = F.when(F.col("style_type") == "character", "character").otherwise("paragraph")
    rows = styles.where(~F.coalesce("is_custom", F.lit(False)) & ~F.col("style_id").isin(*known)).select("pkg_id", "style_id", kind.alias("_kind"), folded(F.col("name")).alias("_fold"))
    return rows.join(F.broadcast(names), ["_kind", "_fold"]).select("pkg_id", "style_id", "meant").distinct()


def continuation(role: Column, style: Column, custom: Column, numbered: Column) -> Column:
    """What a list paragraph without a number of its own may be: `candidate`, or `rejected` for a custom style; else null."""
    listed = (role == "paragraph") & style.isin(*CONTINUATION) & ~F.coalesce(numbered, F.lit(False))
    return F.when(listed & F.coalesce(custom, F.lit(False)), "rejected").when(listed, "candidate")


def cell_style(style: Column, name: Column, custom: Column) -> Column:
    """Whether a table cell's paragraph may have the style: none, Normal that is not custom, or the controlled one."""
    own = (style == "TEIcell") & (name == CONTROLLED["TEIcell"]) & F.coalesce(custom, F.lit(False))
    return F.coalesce(style.isNull() | ((style == "Normal") & ~F.coalesce(custom, F.lit(False))) | own, F.lit(False))


def controlled_status(style: Column, name: Column, custom: Column, kind: Column) -> Column:
    """valid: id and visible name of one controlled style, custom, of a paragraph; invalid: one of them alone; else unrelated."""
    names = F.create_map(*(F.lit(x) for pair in CONTROLLED.items() for x in pair))
    exact = (names[style] == name) & F.coalesce(custom, F.lit(False)) & (kind == "paragraph")
    partly = style.isin(*CONTROLLED) | name.isin(*CONTROLLED.values())
    return F.when(exact, "valid").when(partly, "invalid").otherwise("unrelated")


def inline_reference(style: Column, name: Column, custom: Column, kind: Column) -> Column:
    """valid: id and visible name of the style of references inside a paragraph, custom, of characters; invalid: one of them alone; else null."""
    own, shown = style == INLINE_REFERENCE[0], name == INLINE_REFERENCE[1]
    exact = F.coalesce(own & shown & custom & (kind == "character"), F.lit(False))
    return F.when(exact, "valid").when(F.coalesce(own, F.lit(False)) | F.coalesce(shown, F.lit(False)), "invalid")


def contents_entry(style: Column, custom: Column) -> Column:
    return F.coalesce(style.isin(*CONTENTS), F.lit(False)) & ~F.coalesce(custom, F.lit(False))


def style_diagnosis(roled: DataFrame) -> DataFrame:
    """An error row for each paragraph whose style has no place in a text: contents, deferred, unsupported."""
    code = F.when(contents_entry(F.col("style_id"), F.col("style_is_custom")), "table_of_contents_not_serializable").when(F.col("role") == "deferred", "deferred_paragraph_style").when(F.col("role") == "unsupported", "unsupported_paragraph_style")
    return roled.withColumn("code", code).where("code is not null").select("pkg_id", "index", "style_id", "code", F.lit("error").alias("severity"))
