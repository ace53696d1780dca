"""Weights, word lists and thresholds that results depend on."""

#: Weight of each channel, without and with a role.
DEFAULT_WEIGHTS = {
    "source_meaning": 1.00,
    "visual_summary": 0.85,
    "tags": 0.75,
    "asr": 0.55,
    "ocr": 0.45,
    "video_chunk": 0.35,
}
ROLE_WEIGHTS = {
    "opening": {"visual_summary": 1.00, "source_meaning": 0.80, "tags": 0.70, "video_chunk": 0.65, "asr": 0.25, "ocr": 0.20},
    "product": {"visual_summary": 1.00, "source_meaning": 0.95, "tags": 0.75, "video_chunk": 0.55, "asr": 0.35, "ocr": 0.30},
    "proof": {"source_meaning": 1.00, "visual_summary": 0.95, "tags": 0.85, "video_chunk": 0.45, "asr": 0.35, "ocr": 0.35},
    "cta": {"source_meaning": 0.85, "visual_summary": 0.75, "tags": 0.80, "asr": 0.75, "ocr": 0.65, "video_chunk": 0.25},
    "transition": {"visual_summary": 1.00, "video_chunk": 0.80, "tags": 0.55, "source_meaning": 0.45, "asr": 0.15, "ocr": 0.15},
}
#: Words that tie a record to a role.
ROLE_KEYWORDS = {
    "opening": ["开头", "吸引", "对比", "痛点", "效果", "冲击", "展示"],
    "proof": ["证明", "防水", "防汗", "遮瑕", "测试", "对比", "验证"],
    "product": ["产品", "质地", "上脸", "涂抹", "展示", "细节"],
    "cta": ["福利", "促销", "下单", "购买", "优惠", "明星", "代言"],
    "transition": ["过渡", "承接", "动作", "切换"],
}
#: Score changes by risk of burnt-in subtitles and by fit for a voice-over.
SUBTITLE_RISK = {"none": 0.04, "low": 0.04, "medium": -0.08, "high": -0.16}
VOICE_FIT = {"excellent": 0.05, "good": 0.03, "fair": -0.06, "poor": -0.14}
STANDALONE_ROLES = ("opening", "proof", "product")
#: Character classes of captions.
SPEECH_SILENT = r"""[\s，。！？、,.!?；;：:"'“”‘’（）()\[\]【】《》<>+\-_/]+"""
CAPTION_BREAKS = "。！？!?；;，,、：:"
CAPTION_DROPPED = r"[，。,\.、､]"
LINE_START_MARKS = "！？、!?；;：:\"'“”‘’）)]】》"
SENTENCE_ENDS = "。！？!?"
QUERY_BREAKS = r"[\s，。！？、,.!?；;：/]+"
#: Words that captions don't split.
PROTECTED_WORDS = (
    "防晒气垫", "一层一层", "叠粉底", "赶时间", "临时补妆", "补妆", "粉底", "底妆", "防晒", "气垫", "粉扑", "上脸",
    "卡粉", "服帖", "通勤", "早八",
)
#: How a speaker says it (pattern, spoken form, label), in order.
PRONUNCIATION = (
    (r"(?i)SPF\s*50\+", "SPF五十加", "SPF50+"),
    (r"(?i)SPF\s*50", "SPF五十", "SPF50"),
    (r"(?i)PA\s*\+\+\+", "PA三个加", "PA+++"),
    (r"(?i)PA\s*\+\+", "PA两个加", "PA++"),
    (r"(?i)PA\s*\+", "PA加", "PA+"),
    (r"(?<!\d)618(?!\d)", "六一八", "618"),
)
#: Secrets in texts, with what of a match stays.
SECRETS = (
    (r"sk-[A-Za-z0-9_-]{12,}", ""),
    (r"(?i)(Authorization:\s*Bearer\s+)[A-Za-z0-9._-]+", "$1"),
    (r"(\bBearer\s+)[A-Za-z0-9._-]{12,}", "$1"),
    (r"eyJ[A-Za-z0-9._-]{20,}", ""),
    (
        r"(?i)([?&](?:X-Amz-Signature|Signature|Expires|OSSAccessKeyId|security-token|sts_token|access_key_id|access_key_secret)=)[^&\s\"]+",
        "$1",
    ),
    (r"(?i)([?&](?:api[_-]?key|apikey|access[_-]?token|auth[_-]?token|token|secret|sign|signature)=)[^&\s\"]+", "$1"),
)
SECRET_NAMES = r"(?i)key|token|secret|authorization|signature"
#: Intervals.
OVERLAP_S = 0.05
ISLAND_GAP_S, ISLAND_SPAN_S = 0.8, 9.0
MIN_CAPTION_S = 0.05
#: Pairs of fingerprints.
NEAR = (3, 0.55)
STRONG = (4, 0.68)
DURATION_GAP = (1.5, 0.55)
CLOSE_FRAMES = ((9, 12), (6, 18))
#: The order of statuses, least first.
SEVERITY = ("pass", "info", "warning", "manual_review", "block")
#: Where a child's text comes from: its parent, or itself in spite of a wish to refine it.
INHERITED_TEXT = ("parent_context_only", "parent_story_unit_inherited")
UNREFINED_POLICY = "video_only_until_child_vlm_refine"
EXACT_TEXT = ("child_vlm_refined", "child_verified", "highlight_overlap", "story_unit_exact")
#: Markers of policies that forbid loops.
NO_LOOP = ("disabled", "no_loop", "without_loop", "loop disabled")
#: Addresses of stored videos.
STORE, STORE_LEAST, VIDEO_SUFFIXES = "oss://", 80, (".mp4", ".mov", ".m4v", ".avi", ".webm")
#: Words of sections and pictures, by what they are about.
OPENING_PROOF_WORDS = ("倒水", "泼水", "遇水", "防水", "防汗", "测试", "擦拭", "妆容未花", "不渗水", "吸水", "水滴", "实证", "验证")
OPENING_ALLOWED_WORDS = ("遇水", "防水", "防汗", "倒水", "泼水", "测试", "擦拭", "稳定", "持妆证明")
TEXTURE_WORDS = ("粉芯", "膏体", "取粉", "贴肤", "服帖", "质感", "开盖", "礼盒", "外壳", "款式", "陈列", "国风")
TEXTURE_FORBIDDEN_WORDS = (
    "礼盒", "套装", "面膜", "手臂", "试色", "晕染", "精华", "精华液", "灵芝", "高浓", "高浓度", "60倍", "六十倍", "爆浆", "妆养", "养肤",
    "护肤级", "水珠", "水滴", "遇水", "泼水", "倒水", "防水", "防汗", "测试", "擦拭",
)
CTA_USE_WORDS = ("上妆", "轻拍", "粉扑", "脸颊", "额头", "下巴", "眼下", "鼻翼", "妆效", "微笑示意", "使用效果")
CTA_PACKAGING_WORDS = ("礼盒", "陈列", "外壳", "款式", "套装", "活动价")
FACE_WORDS = (
    "粉扑", "轻拍", "上脸", "面部", "脸颊", "脸上", "补妆", "妆效", "底妆", "气色", "柔焦", "服帖", "服贴", "清透", "清爽", "自然",
)
FACE_STRONG_WORDS = ("粉扑", "轻拍", "上脸", "面部", "脸颊", "脸上", "妆效", "底妆", "气色", "柔焦", "服帖", "服贴", "清透")
DETAIL_WORDS = ("开盖", "打开", "粉芯", "膏体", "取粉", "质地", "镜面", "气垫盒", "粉底液", "外观", "手持")
DETAIL_CORE_WORDS = ("开盖", "打开", "粉芯", "膏体", "取粉", "质地", "镜面", "粉底液")
PACKAGING_WORDS = ("礼盒", "陈列", "外壳", "托盘", "多款", "套装", "替换装", "周边", "活动价", "自用", "送人")
PACKAGING_OFFER_WORDS = ("活动价", "自用", "送人")
PROOF_WORDS = ("遇水", "倒水", "泼水", "防水", "防汗", "测试", "擦拭", "水流", "水珠", "喷洒", "纸巾", "按压", "不脱妆", "不渗透", "酱汁")
FORMULA_WORDS = ("精华", "精华液", "灵芝", "高浓", "高浓度", "60倍", "六十倍", "爆浆", "妆养", "养肤")
TOP_UP_HARD_WORDS = ("礼盒", "套装", "面膜", "精华", "精华液", "灵芝", "60倍", "六十倍", "妆养")
#: Words that tell what material can show, those of problems, those that an opening may rest on; counts that make a word strong or well shown; lengths of lists.
SIGNAL_WORDS = (
    "卡粉", "卡纹", "斑驳", "脱妆", "泛油", "油光", "地铁", "粉扑", "轻拍", "上脸", "开盖", "粉芯", "镜面", "手臂", "试色", "倒水", "泼水", "遇水",
    "防水", "擦拭", "纸巾", "礼盒", "替换装", "小样", "陈列", "精华", "水润", "柔焦", "毛孔", "瑕疵", "咖啡", "包", "奶茶",
)
PROBLEM_WORDS = ("卡粉", "卡纹", "斑驳", "脱妆", "泛油", "油光", "地铁")
OPENING_WORDS = ("补妆", "轻拍", "上脸", "粉扑", "开盖", "粉芯", "柔焦", "精华", "礼盒", "陈列")
STRONG_COUNT, EVIDENCE_COUNT = 2, 3
MOST_TERMS, MOST_POINTS, MOST_TYPES, MOST_EXAMPLES = 30, 24, 18, 18
