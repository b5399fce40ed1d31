"""Patterns, word lists and limits that decide results, in Java's regex syntax."""

SCRIPT = r"(?is)<script\b[^>]*>.*?</script\s*>"
STRAY_SCRIPT = r"(?is)</?script\b[^>]*>"
ACTIVE_ELEMENT = r"(?is)<(?:iframe|object|embed|svg)\b[^>]*>.*?</(?:iframe|object|embed|svg)\s*>"
ACTIVE_TAG = r"(?is)</?(?:iframe|object|embed|svg)\b[^>]*>"
FORM_TAG = r"(?is)</?form\b[^>]*>"
BASE_TAG = r"(?is)<base\b[^>]*>"
META_REFRESH_TAG = r"""(?is)<meta\b[^>]*http-equiv\s*=\s*["']?\s*refresh\b[^>]*>"""
EXTERNAL_LINK_TAG = r"""(?is)<link\b[^>]*href\s*=\s*["']\s*(?:https?:)?//[^"']*["'][^>]*>"""
EVENT_ATTRIBUTE = r"""(?is)\s+on[a-z][a-z0-9_-]*\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>]+)"""
UNSAFE_URL_ATTRIBUTE = (
    r"""(?is)\s+(?:src|srcset|poster|action|href)\s*=\s*(?:"\s*(?:javascript:|https?://|//)[^"]*"|'\s*(?:javascript:|https?://|//)[^']*')"""
)
UNSAFE_STYLE_ATTRIBUTE = (
    r"""(?is)\s+style\s*=\s*(?:"[^"]*(?:javascript:|expression\s*\(|url\s*\(\s*['"]?\s*(?:https?:|//))[^"]*"|"""
    r"""'[^']*(?:javascript:|expression\s*\(|url\s*\(\s*["']?\s*(?:https?:|//))[^']*')"""
)
OWN_ATTRIBUTE = r"""(?is)\s+data-(?:content|chapter-id|block-id)(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>]+))?"""
STYLE_BLOCK = r"(?is)<style\b[^>]*>(.*?)</style\s*>"
CSS_IMPORT = r"""(?is)@import\s+(?:url\s*\([^)]*\)|"[^"]*"|'[^']*')[^;]*;"""
CSS_EXTERNAL_URL = r"""(?is)url\s*\(\s*["']?\s*(?:https?:|//)[^)]*\)"""
CSS_EXPRESSION = r"(?is)expression\s*\([^)]*\)"
ACTIVE_TEXT = (
    r"(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<noscript\b[^>]*>.*?</noscript\s*>|<template\b[^>]*>.*?</template\s*>"
)
TAG = r"(?is)<[^>]+>"
TITLE = r"(?is)<title\b[^>]*>(.*?)</title\s*>"
H1 = r"(?is)<h1\b[^>]*>(.*?)</h1\s*>"
BODY = r"(?is)<body\b[^>]*>(.*?)</body\s*>"
NOT_MAIN = (
    r"(?is)<nav\b[^>]*>.*?</nav\s*>|<header\b[^>]*>.*?</header\s*>|<footer\b[^>]*>.*?</footer\s*>"
    r"|<aside\b[^>]*>.*?</aside\s*>|<form\b[^>]*>.*?</form\s*>"
)
BLOCK_OPEN = r"(?is)<(p|li|blockquote|pre|h[1-6]|td|th)(\s[^>]*)?>"
BLOCK_ELEMENT = r"""(?is)<([a-z][a-z0-9:-]*)\b[^>]*\bdata-block-id\s*=\s*["']([^"']+)["'][^>]*>"""
MAIN_OPEN, MAIN_CLOSE = r"(?is)<main\b[^>]*>", r"(?is)</main\s*>"
BODY_OPEN, BODY_CLOSE = r"(?is)<body\b[^>]*>", r"(?is)</body\s*>"
SIDE_TAG = r"(?is)<(/?)(p|li|blockquote)\b([^>]*)>"
SIDE_QUOTE = r"""(?is)\bclass=["'][^"']*\bepigraph\b[^"']*["']"""
IMAGE_SOURCE = r"""(?is)(<img\b[^>]*\bsrc\s*=\s*["'])([^"']+)(["'][^>]*>)"""
META_FORWARD = r"""(?is)<meta\b[^>]*{key}[^>]*content\s*=\s*["']([^"']+)["'][^>]*>"""
META_REVERSE = r"""(?is)<meta\b[^>]*content\s*=\s*["']([^"']+)["'][^>]*{key}[^>]*>"""
ANCHOR = r"""(?is)<a\b[^>]*\bhref\s*=\s*["']([^"'#]+)["'][^>]*>(.*?)</a\s*>"""
IMAGE = r"(?is)<img\b"
PROTECTED = r"(?is)<code\b[^>]*>.*?</code\s*>|<kbd\b[^>]*>.*?</kbd\s*>|<samp\b[^>]*>.*?</samp\s*>|<img\b[^>]*>"
INLINE_EVENT = r"(?is)<[a-z][^>]*\son[a-z]+\s*="
SCRIPT_URL = r"""(?is)<[a-z][^>]*\b(?:href|src|action)\s*=\s*["']\s*javascript:"""
META_REFRESH = r"""(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["']\s*refresh\s*["']"""
EXTERNAL_RESOURCE = (
    r"""(?is)(?:<[a-z][^>]*\b(?:src|poster|action)\s*=\s*["']\s*https?://|<link\b[^>]*\bhref\s*=\s*["']\s*https?://)"""
)
FORBIDDEN_TAGS = [("<script", "script"), ("<iframe", "iframe"), ("<object", "object"), ("<embed", "embed"), ("<form", "form"), ("<svg", "svg")]
ENTITIES = [("&nbsp;", " "), ("&#160;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")]
HAN = r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}"
SAFE_ID = r"^[A-Za-z0-9][A-Za-z0-9._:-]{0,127}$"
PAGE_NUMBER = r"(?i)^(?:[0-9]+|[ivxlcdm]+)$"
HEADING_EN = r"(?i)^chapter\s+([0-9ivxlcdm]+)(?:$|[^\p{L}\p{N}\p{M}_])"
HEADING_ZH = r"^第\s*([一二三四五六七八九十百0-9]+)\s*章"

PERMANENT_FAILURES = [
    "找不到可执行文件", "无法启动 agent 运行时", "需要登录", "not logged in", "please login", "please log in", "authentication", "unauthorized",
    "forbidden", "invalid api key", "permission denied", "额度不足", "余额不足", "insufficient quota", "billing", "credit balance", "usage limit",
]
TRANSIENT_FAILURES = [
    "at capacity", "overloaded", "rate limit", "too many requests", "status code: 429", "status code: 500", "status code: 502", "status code: 503",
    "status code: 504", "网络连接", "network", "tls handshake", "stream disconnected", "error sending request", "timed out", "timeout", "超时",
    "超过 30 分钟", "超过 8 分钟", "connection reset", "connection refused", "broken pipe", "unexpected eof", "temporarily unavailable",
    "service unavailable", "没有返回回答", "没有返回翻译结果",
]
SPLIT_TRIGGERS = ["Schema", "结构化翻译结果", "无效结构化", "结构化工具输入", "译文", "正文块", "超过 8 分钟", "超过 30 分钟"]
RETRY_SECONDS = [5, 15, 30, 60, 120]
STAGE_LABELS = {
    "queued": "等待生成", "snapshot": "校验来源快照", "converting": "转换静态 HTML", "contract": "建立书籍契约", "translating": "Agent 翻译",
    "validating": "质量与安全校验", "publishing": "写入书架", "paused": "已暂停", "failed": "需要处理", "completed": "生成完成", "cancelled": "已取消",
}
STAGE_PROGRESS = {"snapshot": 8, "converting": 18, "contract": 42, "translating": 56, "validating": 84, "publishing": 94, "completed": 100}
CONTENT_TYPES = {
    "css": "text/css; charset=utf-8", "json": "application/json; charset=utf-8", "jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png",
    "gif": "image/gif", "webp": "image/webp", "ico": "image/x-icon", "woff": "font/woff", "woff2": "font/woff2", "ttf": "font/ttf",
    "txt": "text/plain; charset=utf-8",
}
SETTING_RANGES = {"reader-font-size": (80, 160), "sidebar-width": (280, 560), "ai-sidebar-width": (340, 720)}
BATCH_BLOCKS, BATCH_CHARS = 80, 12_000
FINISHED = 0.995
IMAGE_TYPES = ["jpg", "jpeg", "png", "gif", "webp", "avif"]
LOCAL_IMAGES, INVALID_ATTEMPTS, ATTEMPTS = 500, 3, 6
MISSING_IMAGE = '<span class="missing-image">[图片资源不可用]</span>'
BATCH_SCOPES = ["translation.batch.", "pdf.page."]
# What the lines of a worker's log are told as, and what is said where none can be told.
LOG_SAID = {"thread.started": "Codex 会话已建立", "turn.started": "Agent 正在生成结构化译文", "result": "Agent 已返回结果，正在校验", "turn.completed": "Agent 已返回结果，正在校验"}
LOG_INIT, LOG_NOTHING = "Agent 会话已建立", "Agent 正在处理当前批次，尚未产生可展示文本"
# Signs of a failing network in a log.
NETWORK = ["network", "connection", "stream disconnected", "tls handshake", "网络"]
# Fixed values of packages: ids, languages, file types that may be in one, names of covers by rank.
UUID = r"(?i)^[0-9a-f]{8}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{12}$"
LANGUAGE = r"^[A-Za-z]{2,8}(-[A-Za-z0-9]{1,8})*$"
ALLOWED = ["html", "htm", "css", "json", "jpg", "jpeg", "png", "gif", "webp", "avif", "ico", "woff", "woff2", "ttf", "txt"]
COVERS = ["cover.jpg", "cover.jpeg", "cover.png", "cover.webp"]
# What a live task is shown to do after each kind of event.
PHASE_TOOL, PHASES = "Agent 正在使用", {"tool_completed": "Agent 正在组织回答", "turn_completed": "回答完成", "cancelled": "请求已停止"}
