"""Schemas of the document tables and of the file formats."""

from __future__ import annotations

REGION = "struct<top_left_x:double,top_left_y:double,width:double,height:double>"
LINE = ("struct<id:string,type:string,text:string,text_display:string,subtype:string,column:int,children_ids:array<string>,parent_id:string,block_num:int,par_num:int,"
        f"conf:double,font_size:double,region:{REGION},cell_row:int,cell_column:int,cell_row_span:int,cell_col_span:int>")
PAGE = f"struct<page:int,image_id:string,page_width:double,page_height:double,languages_detected:array<string>,lines:array<{LINE}>>"
LINE_DUMP = f"source string, pages array<{PAGE}>"

OBJECT = "bibkey string, id string, type string, page int, flow_index long, parent string, text string, props map<string,string>"
REALIZATION = "bibkey string, object_id string, stream string, start string, end string, role string, props map<string,string>, provenance string, score double"
ALIGNMENT = "bibkey string, kind string, left struct<stream:string,start:string,end:string>, right struct<stream:string,start:string,end:string>, props map<string,string>"
LINE_TABLE = "bibkey string, stream string, anchor_id string, pos long, page int, type string, text string"
META = "bibkey string, key string, value string"

_RES = "struct<`_rdf:resource`:string>"
AUTHORITY = ("`_rdf:about` string, `gndo:preferredNameForTheSubjectHeading` string, `gndo:variantNameForTheSubjectHeading` array<string>, "
             f"`gndo:broaderTermGeneral` array<{_RES}>, `gndo:relatedTerm` array<{_RES}>, `rdf:type` array<{_RES}>, `gndo:gndSubjectCategory` array<{_RES}>")
SYNSET = "`_id` string, `_category` string, lexUnit array<struct<`_id`:string,orthForm:string>>, paraphrase string"

# Names of rectangle columns.
RECT_COLUMNS = {
    "corner": [("x0", "y0", "x1", "y1"), ("left", "top", "right", "bottom"), ("xmin", "ymin", "xmax", "ymax")],
    "xywh": [("x", "y", "w", "h"), ("left", "top", "width", "height"), ("top_left_x", "top_left_y", "width", "height")],
}
