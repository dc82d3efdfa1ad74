"""Schemas of the relational document model. Schemas are explicit everywhere; nothing is inferred."""

from __future__ import annotations

#: The ordered node table: a row for each block, structural part (item, row, cell, column) and span of a document.
NODES = (
    "doc_id long, seq int, parent_seq int, slot string, ord int, depth int, path string, kind string, type string, node_id string, "
    "text string, level int, style string, start int, checked boolean, language string, url string, title string, asset string, alt string, "
    "latex string, variant string, target_ref string, col int, col_span int, row_span int, role string, header_row boolean, "
    "origin string, loss_class string, summary string, payload_ref string, label string, extra string"
)
#: What an import or export could not carry over.
LOSS = "doc_id long, direction string, seq int, feature string, loss_class string, location string, action string, detail string, message string"
#: Payloads that are kept as they were.
PRESERVED = "doc_id long, path string, origin string, seq int, bytes binary"
ASSETS = "doc_id long, ord int, asset_id string, filename string, mime string, size long, sha256 string, storage string, path string, url string, bytes binary"
ANNOTATIONS = "doc_id long, ord int, annotation_id string, type string, target_kind string, target_block string, exact string, prefix string, suffix string, value string, author string"
#: Entries of a container or package.
ENTRIES = "doc_id long, name string, ord int, size long, compressed_size long, method string, crc_ok boolean, bytes binary, warning string"

NODE_FIELDS = [f.split()[0] for f in NODES.split(", ")]
LOSS_CLASSES = ("none", "partial", "degraded", "unsupported", "preserved_raw")

#: The closed lists of node and span types.
NODE_TYPES = (
    "section", "paragraph", "heading", "quote", "list", "list_item", "code_block", "table", "figure", "image", "horizontal_rule", "page_break",
    "math_block", "callout", "embed", "footnote", "unknown",
)
SPAN_TYPES = (
    "text", "hard_break", "strong", "em", "underline", "strike", "code", "link", "footnote_ref", "inline_math", "inline_image", "mention", "cite", "unknown",
)
#: Id prefixes and the alphabet of their digits.
ID_PREFIXES = ("doc", "sec", "blk", "li", "cel", "col", "row", "as", "ann", "rev", "pub", "iss")
ID_ALPHABET = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"
ID_DIGITS = 26
