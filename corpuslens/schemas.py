"""Explicit schemas of the data model, as DDL; nothing is inferred from files."""

from __future__ import annotations

DOCUMENT = (
    "source_uid string, source string, title string, jurisdiction_type string, jurisdiction_name string, location string, date_lecture date, "
    "docket_numbers array<string>, ecli string, full_text string, sections array<struct<label:string,kind:string,start_char:int,end_char:int,text:string>>"
)
CHUNK = "doc_id long, chunk_index int, char_start int, char_end int, ctx_start int, body string, ctx string"
ARTICLE = "text_uid string, num_key string, date_debut date, date_fin date, num string, body string, title_path string, etat string"
SPAN = "char_start int, char_end int, ref_text_uid string, ref_num_key string, suivants boolean"
ENTITY = "uid string, category string, name string, denominations array<struct<d:string,du:date,au:date>>"
PARTY = "doc_id long, ord int, quality string, side string, value string, resolve_key string, entity_uid string"
TOC_EDGE = "owner_uid string, seq int, child_kind string, child_uid string, label string, date_debut date, date_fin date"
MEMBER = "archive string, member string, raw binary"
