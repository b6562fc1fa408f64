"""Record schemas shared by the operators."""

from __future__ import annotations

ASSET = "file string, text string"
RULE = "rule_name string, regex string, series string, is_mechanical string, entropy double, need_keyvalue boolean"
HIT = ("file string, rule_name string, series string, is_mechanical string, value string, match string, entropy double, "
       "line_start int, line_end int, col_start int, col_end int, index_start int, index_end int, ord bigint")
CONTEXT = "array<struct<path:string,snippet:string,tag:string,type:string,scope:string>>"
KB = "id string, vector array<float>, service string, risk_level string"
RESOURCE = ("index int, url string, method string, status int, resource_type string, content_type string, "
            "saved_path string, size_bytes bigint, is_soft_404 boolean, content binary")
FINDING = "risk string, value string, variable string, rule string, file string, line int, reason string, score double"
EXTRACTED = "value string, line_start int, line_end int, ord int, parse_ok boolean"
HIT_KEY = ("file", "rule_name", "value", "index_start", "index_end")
