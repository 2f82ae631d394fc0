"""Row types that operators exchange."""

from __future__ import annotations

UNIT = "uid string, spec string, section string, section_title string, subref string, anchor string, text string, char_start int, char_end int"
BLOCK = "source_id string, pos int, section string, section_title string, subref string, text string, is_list boolean"
PP = "uid string, parser string, off int, prep string, head string, head_off int"
COORD = "uid string, parser string, off int, cc string, conj array<struct<text:string,start:int>>"
TERM = "norm string, term string, concept_id string, kind string, source string, definition string"
TOKENS = "array<struct<i:int,text:string,pos:string,dep:string,head:int>>"
CHUNKS = "array<struct<root_i:int,root_text:string,root_pos:string>>"

# parsers in their order; the first at a locus names it
PARSERS = ("low", "high", "lexical", "object")
