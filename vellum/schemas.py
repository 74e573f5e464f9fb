"""Schemas of the data model (pages, extractions, search rows, graph, tables, events, registries)."""

PAGE = "path string, stem string, dir string, type string, title string, created string, text string"
EXTRACTION = "path string, title string, body string, date string, source_path string, sha256 string, fm map<string,array<string>>"
SEARCH_ROW = "path string, title string, body string, date string, source_path string"
EMBEDDING = "vec_id long, embedding array<float>"
VERTICES = {"WikiPage": "path string, type string, title string", "VaultSource": "path string, title string", "DataRow": "key string, table_name string, row_id string", "Note": "id string, content_hash string, created string"}
EDGES = {"WikiLink": "src string, dst string", "Cites": "src string, dst string", "DataRef": "src string, dst string, col_name string", "Depicts": "src string, dst string", "AppearsIn": "src string, dst string"}
EXTRACTED_ROW = "table_stem string, source_stub string, source_extraction string, headers array<string>, row_idx int, cells array<string>, extraction_sha string"
EVENT = "ts timestamp, kind string, page string, source string, action string, ingest_kind string, projects array<string>"
PROJECT = "name string, created_at string, deleted_at string, description string, home_page string"
CHEMICAL = "name_norm string, smiles string, inchi string, inchikey string, cid string, source string, status string, fetched_at string"
GENE = "symbol_norm string, ensembl_id string, uniprot_id string, entrez_id string, taxid string, source string, status string, fetched_at string"

# fixed values: declared column types and what they are stored as
COLUMN_TYPES = {
    "text": "string", "str": "string", "string": "string", "int": "bigint", "integer": "bigint", "real": "double", "float": "double", "number": "double",
    "bool": "boolean", "boolean": "boolean", "date": "string", "datetime": "string", "timestamp": "string", "enum": "string", "wikilink": "string", "ref": "string",
    "json": "variant", "blob": "binary",
}
# fixed values: page types, their display prefixes and stem prefixes
PAGE_TYPES = ["entity", "concept", "source", "analysis", "evidence", "fact", "summary-table", "extracted-table", "figure", "note", "todo-list", "project"]
TYPE_PREFIX = {
    "concept": "[con]", "entity": "[ent]", "analysis": "[ana]", "source": "[src]", "evidence": "[evi]", "fact": "[fact]", "summary-table": "[tbl]",
    "extracted-table": "[tab]", "figure": "[fig]", "note": "[note]", "todo-list": "[todo]", "project": "[proj]",
}
STEM_PREFIX = {"summary-table": "tbl-", "extracted-table": "tab-", "figure": "fig-"}


def column_type(name: str) -> str:
    """Storage of a declared column type; unknown names are text."""
    return COLUMN_TYPES.get(name.lower(), "string")
