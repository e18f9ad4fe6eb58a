"""Schemas of the tables that the operators exchange."""

FIELDS_TYPE = "map<string,string>"
BIB_FILES = "project string, file string, content binary"
TEX_FILES = "project string, file string, content string"
ENTRIES = (
    "project string, file string, pos int, entry_type string, key_raw string, key string, "
    "fields map<string,string>, n_fields int, is_commented boolean, raw string"
)
BLOCKS = "pos int, at int, kind string, entry_type string, key_raw string, fields map<string,string>, raw string, error string"
CITATIONS = "project string, file string, cite_pos int, key_pos int, key_raw string, key string"
KEY_MAP = "project string, step int, seq long, file string, old_key string, new_key string"
JOURNALS = "full string, short string, priority int, row_no long"
ISSUES = "project string, check string, file string, key string, message string"

#: Fields that the formatter drops.
DROPPED_FIELDS = (
    "file", "urldate", "langid", "keywords", "abstract", "Bdsk-Url-1", "Bdsk-Url-2",
    "note", "annote", "comment", "timestamp", "date-added", "date-modified",
)
#: The order in which an entry's fields are written; all others follow by name.
FIELD_ORDER = ("title", "author", "journal", "year", "volume", "number", "pages", "doi", "url", "publisher")
