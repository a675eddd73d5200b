"""Patterns, word lists, thresholds and codes that results must agree on.

Patterns are written for Java's regular expressions with (?U) for Unicode classes, and (?Ud) where a
line's end or a dot matters.
"""

# ---- fixed values: characters ----
CHARACTERS = {
    "ꎬ": "，", "ꎻ": "；", "ꎮ": "。", "􀆰": ".", "􀆺": "…", "､": "，", "｡": "。", "﹐": "，",
    "﹑": "、", "．": "。", "﹒": "。", "　": " ", "\xa0": " ",
}
#: Full-width digits and letters stand 0xFEE0 above the plain ones.
CHARACTERS |= {chr(c + 0xFEE0): chr(c) for c in (*range(48, 58), *range(65, 91), *range(97, 123))}

# ---- fixed values: lines ----
USELESS_KEYWORDS = ["版权所有", "定价", "ISBN", "CIP", "图书在版编目", "出版发行", "责任编辑", "责任校对", "封面设计", "策划编辑", "微信公众号"]
PAGE_NUMBER_LINES = [r"-?\s*\d+\s*-?", r"第\s*\d+\s*页", r"(?i:Page\s*\d+)", r"[ⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩ]+"]
NOISE_LINES = [r"[-—_=*·•●]+"]
CAPITALS_LINE, CAPITALS_LONGER_THAN = r"[A-Z\s]+", 10
TOC_TITLE = r"目\s*录"
TOC_PAGE_AT_END = r"(?:\(|（)?\s*[ⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩ\d]+\s*(?:\)|）)?\s*$"
TOC_LEADER = r"[.\-_\s]{4,}"
TOC_DOTS, TOC_DOTTED_LENGTH, TOC_BLOCK = 4, 180, 3
CHAPTER_START = r"^第\s*[一二三四五六七八九十百千万\d]+\s*章"
REPEATED_LENGTH, REPEATED_PAGES, REPEATED_SHARE = 60, 3, 0.25
STANDALONE_STARTS = [r"^第[一二三四五六七八九十\d]+章", r"^[一二三四五六七八九十]+[、.．]", r"^\d+[.．、]\s*"]
SENTENCE_ENDS = "。！？；：.!?;:"
MEANINGFUL = r"[一-鿿A-Za-z0-9]"
OCR_BELOW = 20

# ---- fixed values: structure ----
GENERIC_HEADINGS = [
    r"^第[一二三四五六七八九十百千万\d]+[章节篇部分].{0,80}$",
    r"^\d+(?:\.\d+)*[、.．]?\s+.{2,80}$",
    r"^[一二三四五六七八九十]+[、.．]\s*.{2,80}$",
    r"^[（(][一二三四五六七八九十\d]+[）)]\s*.{2,80}$",
    r"^[A-Z][、.．]\s+.{2,80}$",
]
CHAPTERS = [r"^第\s*[一二三四五六七八九十百千万\d]+\s*章\s+.{1,80}$"]
SECTIONS = [r"^第\s*[一二三四五六七八九十百千万\d]+\s*节\s+.{1,80}$"]
QUESTIONS = [r"^\d+[、.．]\s*.{2,80}[？?]\s*$"]
_ITEMS = "案例|例子|示例|实例|问题|题目|任务|实验|项目|条目|记录|事件|步骤|模块"
CLUES = {
    "chapter_like": [r"^第[一二三四五六七八九十百千万\d]+[章节篇部分]\s*[^\n]{0,80}$"],
    "numbered_heading_like": [r"^\d+(?:\.\d+)*[、.．]?\s+[^\n]{2,80}$"],
    "chinese_number_heading_like": [r"^[一二三四五六七八九十]+[、.．]\s*[^\n]{2,80}$"],
    "bracket_heading_like": [r"^[（(][一二三四五六七八九十\d]+[）)]\s*[^\n]{2,80}$"],
    "item_like": [rf"^({_ITEMS})\s*[一二三四五六七八九十百千万\d]+(?:[-－—.]\d+)*\s*[^\n]{{0,100}}$", rf"^({_ITEMS})\s*[:：]\s*[^\n]{{1,100}}$"],
}
CLUE_WORDS = ["章节", "小节", "部分", "模块", "案例", "例子", "示例", "实例", "问题", "题目", "任务", "实验", "项目", "条目", "记录", "事件", "系统", "设备", "部件", "现象", "原因", "方法", "措施", "步骤", "流程", "结论"]
CLUE_LENGTH, CLUE_PREVIEW, TITLE_LENGTH, SLUG_LENGTH = 120, 100, 200, 40
PREVIEW_CHARS = 24000

# ---- fixed values: chunks ----
CHUNK_CHARS, CHUNK_OVERLAP = 3000, 300
WINDOW_CHARS, WINDOW_OVERLAP = 1400, 120
PART_CHARS, PART_OVERLAP = 2200, 120
SENTENCE_BREAK = "[。！？!?；;]"
MIN_CHARS, IDEAL_CHARS, MAX_CHARS, MIN_DENSITY = 80, 4000, 6000, 0.45
INCOMPLETE_STARTS = [r"^(因此|所以|然后|此外|同时|另外|进一步|由此可见|综上|这说明)", r"^(该|其|上述|前述|这种|这些|他们|它们|为此)"]
INCOMPLETE_ENDS = [r"(为|包括|如下|分别为|主要有|原因是|方法是|措施是|步骤如下|例如|即)[:：]?$"]
CLEAR_ENDS = r"[。！？.!?；;）)]$"
PENALTIES = {"missing_content": 100, "missing_title": 15, "too_short": 30, "too_long": 30, "slightly_long": 10, "possible_incomplete_start": 15, "possible_incomplete_end": 15, "end_without_clear_punctuation": 8, "low_content_density": 20}
LEVELS = [(90, "excellent"), (70, "good"), (50, "warning")]

# ---- fixed values: graphs ----
OTHER_TYPE, VAGUE_RELATION = "其他", "相关"
VAGUE_WORDS = ["相关", "其他", "问题", "内容", "情况", "方面", "对象", "概念"]
SHORT_TEXT, EVIDENCE_TEXT, NAME_TEXT, TYPE_TEXT = 180, 120, 120, 80
MERGE_BATCH, RELATION_BATCH, RELATION_EXAMPLES, REPORT_ITEMS = 80, 100, 5, 30
ONTOLOGY_CAPS = {"entity_types": 12, "relation_types": 16, "relations": 24, "design_notes": 8}

# ---- fixed values: conversations ----
INTENT_WORDS = ["生成", "抽取", "开始", "运行", "执行", "创建", "构建", "整理", "分析", "审核", "校对", "总结", "摘要", "报告", "问答", "知识图谱", "实体", "关系", "workflow", "工作流", "流程"]
CONFIRMATION_MARKER = "确认后，我再生成 workflow"
CONFIRMATIONS = ["确认", "确认无误", "没问题", "没有问题", "理解正确", "理解准确", "准确", "是的", "对", "对的", "可以", "同意", "继续", "生成吧", "请生成", "开始生成"]
CONFIRMATION_PATTERN = r"(?:好的?)?(?:确认(?:无误)?|同意|没(?:有)?问题|理解(?:正确|准确))(?:了)?(?:请)?(?:生成|开始生成|继续生成)?(?:workflow|工作流|流程)?(?:吧)?"
REPLY_PUNCTUATION = r"[\s，。！？、,.!?]+"
HISTORY_MESSAGES, MESSAGE_CHARS, CONTEXT_CHARS = 12, 4000, 12000
QUERY_PREFIX = "Represent this sentence for searching relevant passages: "
TOP_K, MOST_K = 5, 20
