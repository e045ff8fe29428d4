"""Parts that all Office packages share."""

from __future__ import annotations

from ..functions.text import escape_xml

HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
# Namespaces of Open Packaging and Office Open XML.
OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
CORE = f"{PACKAGE}/relationships/metadata/core-properties"


def part(root: str, space: str, body: str, prefix: str = "", more: str = "") -> str:
    """An XML part with the relationships namespace bound to r."""
    bound = f"xmlns:{prefix}" if prefix else "xmlns"
    name = f"{prefix}:{root}" if prefix else root
    return f'{HEAD}<{name} {bound}="{space}" xmlns:r="{OFFICE}"{more}>{body}</{name}>'


def relationships(targets: list[tuple[str, str]]) -> str:
    """Relations rId1, rId2, ... of (kind, target)."""
    rows = "".join(f'<Relationship Id="rId{i}" Type="{k if "://" in k else f"{OFFICE}/{k}"}" Target="{t}"/>' for i, (k, t) in enumerate(targets, 1))
    return f'{HEAD}<Relationships xmlns="{PACKAGE}/relationships">{rows}</Relationships>'


def package(main: str, overrides: dict[str, str], title: str, stamp: str) -> list[tuple[str, str]]:
    """Content types, package relations and properties.  stamp is an ISO time, so that equal input
    gives equal bytes."""
    kinds = {**overrides, "/docProps/core.xml": "application/vnd.openxmlformats-package.core-properties+xml",
             "/docProps/app.xml": "application/vnd.openxmlformats-officedocument.extended-properties+xml"}
    listed = "".join(f'<Override PartName="{p}" ContentType="{k}"/>' for p, k in kinds.items())
    types = (f'{HEAD}<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
             f'<Default Extension="xml" ContentType="application/xml"/>{listed}</Types>')
    core = (f'{HEAD}<cp:coreProperties xmlns:cp="{PACKAGE}/metadata/core-properties" xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:dcterms="http://purl.org/dc/terms/" '
            f'xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance"><dc:title>{escape_xml(title)}</dc:title><dcterms:created xsi:type="dcterms:W3CDTF">{stamp}</dcterms:created>'
            f'<dcterms:modified xsi:type="dcterms:W3CDTF">{stamp}</dcterms:modified></cp:coreProperties>')
    app = f'{HEAD}<Properties xmlns="http://schemas.openxmlformats.org/officeDocument/2006/extended-properties"><Application>Vellumry</Application></Properties>'
    rels = relationships([("officeDocument", main), (CORE, "docProps/core.xml"), ("extended-properties", "docProps/app.xml")])
    return [("[Content_Types].xml", types), ("_rels/.rels", rels), ("docProps/core.xml", core), ("docProps/app.xml", app)]
