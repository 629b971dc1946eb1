"""Explicit schemas of the file formats."""

OFFSETS = ("sentence string, head string, tail string, head_offset string, tail_offset string, head_type string, "
           "tail_type string, relation string, head_end_offset string, tail_end_offset string")
IE_RECORD = ("text string, entity array<struct<entity:string,entity_type:string>>, "
             "relation array<struct<head:string,head_type:string,relation:string,tail:string,tail_type:string>>, "
             "event array<struct<event_trigger:string,event_type:string,arguments:array<struct<argument:string,role:string>>>>")
TRIPLE = "head string, subject string, relation string, predicate string, tail string, object string, sentence string, text string"
EDGE = "source string, target string, relation string"
EXPORTED = "relationships array<struct<source:string,target:string,relation:string>>"
