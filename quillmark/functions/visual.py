"""Column expressions that read visual intent from questions and reading plans from visual resources."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmark.functions.text import empty, filled

# fixed values: words of visual intent; ideographs first, then whole Latin words
INTENT = {
    "visual_reference": ("图中|原图|图片|图像|照片|画面|截图|流程图|示意图|架构图", r"figure|fig\.?|image|photo|screenshot|diagram|chart|plot"),
    "color_depth": ("[红橙黄绿青蓝紫黑白灰粉棕](?:色|线|框|块|区域)|颜色|色彩|深色|浅色|明暗|亮度|深浅", "red|orange|yellow|green|blue|purple|black|white|gray|grey|pink|brown|color|colour|dark|light|brightness"),
    "position": ("左侧|右侧|上方|下方|顶部|底部|中间|中央|角落|位置|方位|左右|上下", "left|right|above|below|top|bottom|middle|center|corner|position"),
    "connection": ("箭头|指向|连线|连接关系|相连|数据流|流向|流程图|框图|拓扑", r"arrow|point(?:s|ing)?\s+to|connect(?:ed|ion)?|link|flowchart|data\s+flow|topology"),
    "trend": ("曲线|折线|柱形|柱状|趋势图|走势图|坐标轴", r"curve|line\s+chart|bar\s+chart|histogram|axis"),
    "scene": ("物体|物品|场景|背景中|前景中", "object|scene|foreground|background"),
    "spatial_quantity": ("空间关系|相对位置|相邻|重叠|遮挡|包含关系|排列|间距", "spatial|adjacent|overlap|occlusion|arrangement"),
}
CONTEXT = {
    "connection": ("流程|过程", "process|pipeline"),
    "trend": ("趋势|走势|峰值|谷值|上升|下降|波动", "trend|peak|valley|rising|falling"),
    "scene": ("人物|人像|车辆|动物|建筑", "person|people|vehicle|animal|building"),
    "spatial_quantity": ("分布|距离", "distance|distribution"),
}
COUNTING = ("多少|几个|几人|数量|数一数", r"how\s+many")
ANCHORS = ("visual_reference", "color_depth", "position", "connection", "trend", "scene")
TABLE_WORDS = "表|表格|table|行|列"
AGGREGATION = ("哪些|有哪|重点数据|主要|分别|各自|列举|汇总|包括|完整", r"list|summari[sz]e|key\s+data|main|respectively")
DIAGRAM = ("流程图|架构图|示意图|框图|数据流|折线|曲线|柱状|趋势", r"pipeline|flowchart|diagram|architecture|chart|plot|curve|bar\s+chart|data\s+flow")
PAGE_SHOT = ("页面截图|整页截图|网页截图", r"page\s+screenshot|screenshot\s+of\s+(?:a\s+)?page")
TABLE_SHOT = ("表格截图|表截图", r"table\s+screenshot|screenshot\s+of\s+(?:a\s+)?table")


def mentions(text: Column, words: tuple[str, str]) -> Column:
    """Whether a text has one of the ideograph words anywhere or one of the Latin words as a whole word."""
    return empty(text).rlike(f"(?i){words[0]}|(?:^|[^a-z0-9_])(?:{words[1]})(?:$|[^a-z0-9_])")


def visual_intent(question: Column) -> Column:
    """The categories of visual intent of a question, in a fixed order; empty where there is none."""
    direct = {c: mentions(question, w) for c, w in INTENT.items()}
    anchored = direct[ANCHORS[0]]
    for c in ANCHORS[1:]:
        anchored = anchored | direct[c]
    has = {c: direct[c] | (anchored & mentions(question, CONTEXT[c])) if c in CONTEXT else direct[c] for c in INTENT}
    has["spatial_quantity"] = has["spatial_quantity"] | ((has["visual_reference"] | has["scene"]) & mentions(question, COUNTING))
    return F.array_compact(F.array(*[F.when(h, F.lit(c)) for c, h in has.items()]))


def table_intent(question: Column) -> Column:
    return F.lower(empty(question)).rlike(TABLE_WORDS)


def aggregation_intent(question: Column) -> Column:
    return mentions(question, AGGREGATION)


def reading_plan(item_type: Column, has_table: Column, has_latex: Column, caption: Column, breadcrumb: Column, metadata: Column) -> Column:
    """struct(resource_type, primary_representation, run_caption, run_ocr, ocr_policy): how a visual resource is read."""
    kind = F.lower(F.trim(empty(item_type)))
    declared = F.lower(F.trim(filled(metadata["visual_type"], metadata["resource_type"], metadata["image_type"])))
    effective = filled(declared, kind)
    context = F.lower(F.concat_ws(" ", empty(caption), empty(breadcrumb)))
    texty = F.exists(F.array(metadata["ocr_required"], metadata["contains_text"], metadata["text_dense"]), lambda x: x.isNotNull() & (x != ""))

    def plan(resource: str, primary: str, caption_: bool, ocr: Column | bool, policy: str | Column) -> Column:
        return F.struct(
            F.lit(resource).alias("resource_type"),
            F.lit(primary).alias("primary_representation"),
            F.lit(caption_).alias("run_caption"),
            F.coalesce(ocr if isinstance(ocr, Column) else F.lit(ocr), F.lit(False)).alias("run_ocr"),
            (policy if isinstance(policy, Column) else F.lit(policy)).alias("ocr_policy"),
        )

    natural = plan("natural_image", "vlm_caption", True, texty, F.when(texty, "always").otherwise("on_demand"))
    page = plan("page_screenshot", "ocr+vlm_caption", True, True, "always")
    table = plan("table_screenshot", "structured_table", False, True, "assistive")
    return (
        F.when(effective.isin("equation", "formula", "formula_screenshot") | has_latex, plan("formula", "latex", False, False, "disabled"))
        .when((kind == "table") | has_table | effective.isin("table", "table_screenshot", "table-image"), table)
        .when(effective.isin("page", "page_image", "page_screenshot", "screenshot"), page)
        .when(declared.isin("natural", "natural_image", "photo", "scene"), natural)
        .when(mentions(context, PAGE_SHOT), page)
        .when(mentions(context, TABLE_SHOT), table)
        .when(effective.isin("chart", "plot", "diagram", "flowchart", "flow_chart", "architecture_diagram") | (kind == "chart") | mentions(context, DIAGRAM), plan("diagram_chart", "ocr+vlm_caption", True, True, "always"))
        .otherwise(natural)
    )
