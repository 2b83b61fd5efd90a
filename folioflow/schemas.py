"""Schemas of the tables that pass between stages."""

from __future__ import annotations

TEXT, TITLE, LIST, TABLE, FIGURE = 1, 2, 3, 4, 5
CATEGORY_NAMES = {TEXT: "text", TITLE: "title", LIST: "list", TABLE: "table", FIGURE: "figure"}
TEXTUAL, VISUAL = (TEXT, TITLE, LIST), (TABLE, FIGURE)

BOX = "struct<x:double,y:double,w:double,h:double>"
ANNOTATION = "struct<id:bigint,category_id:int,bbox:array<double>,category_name:string>"
PAGE = f"key string, doc_id string, page_index int, image binary, width int, height int, annotations array<{ANNOTATION}>"
REGION = (
    "region_id string, doc_id string, page_key string, page_index int, category int, "
    f"bbox {BOX}, reading_order int, text string, caption string, crop_path string"
)
CHUNK = "chunk_id string, doc_id string, page_index int, text string, region_ids array<string>, category int"
TEXT_INDEX = (
    "point_id string, chunk_id string, doc_id string, page_index int, text string, region_ids array<string>, "
    "category int, modality string, dense array<float>, sparse map<int,float>"
)
IMAGE_INDEX = (
    "point_id string, region_id string, doc_id string, page_index int, category int, caption string, "
    "crop_path string, modality string, image array<float>"
)
MENTION = "chunk_id string, pos int, text string, label string, score double"
TRIPLE = "chunk_id string, pos int, subject string, relation string, object string"
NODE = "id string, ntype string, label string, name string, doc_id string, page_index int"
EDGE = "src string, dst string, key string, relation string, chunk_id string"
QA = "question string, qtype string, gold_id string, gold_kind string, gold_doc_id string, gold_page_index int, gold_chunk_id string"
TRIPLES_JSON = "array<struct<subject:string,relation:string,object:string>>"
