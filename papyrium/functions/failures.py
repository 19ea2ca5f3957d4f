"""Failure classification: an ordered ladder of patterns, first match wins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import evidence

# Category, family, retry strategy, repair action, pattern, other pattern that must match too.
# Patterns ignore case; (?s) lets the dot pass line ends.
TRANSLATE_LADDER = (
    ("translate.api_quota", "api", "manual_review", "recharge_api_balance", r"insufficient[_ ](?:user[_ ])?quota|insufficient.*balance|balance .* is insufficient|额度不足|余额不足"),
    ("runtime.workdir_missing", "runtime_path", "reuse_translation", "normalize_compile_workdir", r"(?s)FileNotFoundError.*(?:workfolder|gpt_log/arxiv_cache)"),
    ("translate.source_missing", "source", "restore_source", "verify_source_manifest", r"Tex源文件缺失|source.*not found|找不到.*(?:tex|sty|cls)"),
    ("translate.api_auth", "api", "manual_review", "fix_api_credentials", r"401|403|unauthori[sz]ed|invalid.*api.?key"),
    ("translate.api_rate_limit", "api", "retry_later", "backoff_translation", r"429|rate.?limit|too many requests"),
    ("translate.network_timeout", "network", "retry_translation", "retry_with_backoff", r"timeout|timed out|connection reset|temporary failure"),
    ("translate.plugin_runtime", "plugin", "retry_translation", "inspect_plugin_runtime", r"(?-i)RuntimeError"),
    ("translate.plugin_exception", "plugin", "retry_translation", "inspect_plugin_traceback", r"(?-i)Traceback|\bError:"),
)
TRANSLATE_ELSE = ("translate.unknown", "translation", "retry_translation", "inspect_translation_output")
COMPILE_LADDER = (
    ("compile.macro_recursion", "latex_structure", "reuse_translation", "patch_recursive_macro", r"TeX capacity exceeded|input stack size"),
    ("compile.asset_missing", "asset", "reuse_translation", "replace_missing_graphic", r"Image inclusion failed|Could not find file:.*\.(?:png|jpe?g|pdf|eps)"),
    ("compile.dependency_missing", "dependency", "reuse_translation", "install_or_stub_dependency", r"File [`']?[^\n`']+\.(?:sty|cls|def)[`']? not found"),
    ("compile.legacy_cjk_environment", "latex_command", "reuse_translation", "add_cjk_environment_fallback", r"(?s)Environment CJK\*? undefined|Undefined control sequence.*?endCJK\*?"),
    ("compile.model_response_leak", "translation_artifact", "reuse_translation", "strip_serialized_translation_artifact", r'"translation"\s*:\s*"\\\\section|\[\s*"\\\\section'),
    ("compile.font_family_missing", "latex_font", "reuse_translation", "fallback_sourcesans3_family", r'fontspec Error: The font "SourceSans3-'),
    ("compile.engine_driver_mismatch", "latex_engine", "reuse_translation", "remove_pdftex_graphics_driver", r"(?s)Undefined control sequence.*?\\(?:pdfshellescape|pdfcolorstack)"),
    ("compile.pdftex_primitive", "latex_engine", "reuse_translation", "guard_pdftex_primitive", r"(?s)Undefined control sequence.*?\\pdf(?:infoomitdate|trailerid|suppressptexinfo|gentounicode|output|inclusioncopyfonts)"),
    ("compile.unmatched_environment", "latex_structure", "reuse_translation", "remove_unmatched_environment_ending", r"(?s)Undefined control sequence.*?\\endtcolorbox"),
    ("compile.tikz_matrix_legend", "latex_structure", "reuse_translation", "disable_fragile_tikz_matrix_legends", r"\\pgf@matrix@last@nextcell@options|matrix of nodes"),
    ("compile.duplicated_macro_initial", "translation_artifact", "reuse_translation", "repair_duplicated_macro_initials", r"(?s)Undefined control sequence.*?\\([A-Za-z])\1[A-Za-z@]+"),
    ("compile.undefined_command", "latex_command", "reuse_translation", "patch_undefined_command", r"Undefined control sequence"),
    ("compile.structure_mismatch", "latex_structure", "reuse_translation", "restore_tex_structure", r"begin\{document\} ended by|Runaway argument|Missing \}|Extra \}|Emergency stop"),
    ("compile.numeric_syntax", "latex_syntax", "reuse_translation", "patch_numeric_argument", r"Missing number|Illegal unit of measure"),
    ("compile.math_or_alignment", "latex_syntax", "reuse_translation", "restore_math_or_table_syntax", r"Missing \$ inserted|Extra alignment tab|Misplaced alignment tab"),
    ("compile.verbatim_corruption", "protected_content", "reuse_translation", "restore_protected_environment", r"tcblisting|lstlisting|minted|verbatim", r"LaTeX Error|Package .* Error"),
    ("quality.untranslated_prose", "translation_quality", "retry_translation", "protect_examples_or_retranslate", r"翻译覆盖率检查失败|translation coverage.*failed"),
    ("compile.resource_exhaustion", "runtime_resource", "retry_later", "reduce_compile_resources", r"out of memory|cannot allocate memory|(?:process |compile )killed|segmentation fault|(?:compile|compilation|command) timed? ?out"),
    ("compile.latex_error", "latex", "reuse_translation", "inspect_first_latex_error", r"LaTeX Error|Package .* Error|Fatal error"),
)
COMPILE_ELSE = ("compile.unknown", "compile", "manual_review", "inspect_compile_log")
#: Categories whose patterns read the log and the other error text together.
BOTH_TEXTS = {"quality.untranslated_prose", "compile.resource_exhaustion"}

#: What is shown of a log where that is not the pattern's own match.
SHOWN = {c: "Undefined control sequence" for c in ("compile.engine_driver_mismatch", "compile.pdftex_primitive", "compile.duplicated_macro_initial")}
#: Diagnoses that no log shows: category, family, retry strategy, repair action.
QUALITY = (
    ("quality.pdf_sustained_untranslated", "translation_quality", "retry_translation", "retranslate_pdf_without_tex"),
    ("quality.pdf_partial_untranslated", "translation_quality", "retry_translation", "retranslate_pdf_without_tex"),
    ("quality.translation_refusal", "translation_quality", "retry_translation", "retry_refused_translation"),
)
#: What to do, by category.
SUGGESTIONS = {
    "translate.api_quota": "API 余额或额度不足；充值或切换已授权模型凭据后再重试。",
    "runtime.workdir_missing": "编译工作目录解析失败；规范化容器绝对路径后复用翻译缓存重编译。",
    "translate.source_missing": "源码包或被引用的 TeX 文件缺失；先恢复源码，再重新翻译。",
    "translate.api_auth": "API 鉴权失败；修复凭据后再重试。",
    "translate.api_rate_limit": "API 触发限流；退避后重新翻译。",
    "translate.network_timeout": "网络或 API 请求超时；保留源码并退避重试翻译。",
    "translate.plugin_runtime": "翻译插件运行时异常；检查 traceback，修复后重新翻译。",
    "translate.plugin_exception": "翻译插件抛出异常；根据 traceback 定位后重新翻译。",
    "translate.unknown": "翻译阶段未产生 TeX；检查网络、API 与插件输出后重试。",
    "compile.macro_recursion": "宏递归耗尽 TeX 栈；对照原文修复递归宏后复用翻译重编译。",
    "compile.asset_missing": "图片资源缺失；恢复资源或插入占位图后复用翻译重编译。",
    "compile.dependency_missing": "LaTeX 依赖文件缺失；安装依赖或提供兼容 stub 后重编译。",
    "compile.legacy_cjk_environment": "旧模板使用未加载的 CJK/CJK* 环境；补 XeLaTeX 兼容定义后复用翻译重编译。",
    "compile.model_response_leak": "模型序列化响应泄漏进 TeX；清除整行 JSON/list 残留后复用翻译重编译。",
    "compile.font_family_missing": "slim 镜像缺少 SourceSans3 字体族；映射到兼容 SourceSansPro 字体后重编译。",
    "compile.engine_driver_mismatch": "graphicx 被强制为 pdftex driver；移除错误 driver 选项后由 XeLaTeX 自动选择。",
    "compile.pdftex_primitive": "模板调用了 XeLaTeX 不支持的 pdfTeX 原语；加引擎 guard 后重编译。",
    "compile.unmatched_environment": "存在无对应 begin 的环境结束标签；按环境栈移除多余结束标签后重编译。",
    "compile.tikz_matrix_legend": "TikZ matrix 图例混入显式 node/draw 后破坏单元格解析；省略图例并保留主图与图注。",
    "compile.duplicated_macro_initial": "翻译结果把宏名首字母重复；仅在原文存在对应单首字母宏时恢复宏名。",
    "compile.undefined_command": "存在未定义命令；识别命令来源并补兼容定义或修复宏与中文粘连。",
    "compile.structure_mismatch": "环境、参数或大括号结构被破坏；对照原始 TeX 恢复结构后重编译。",
    "compile.numeric_syntax": "长度或数值参数语法损坏；修正参数后复用翻译重编译。",
    "compile.math_or_alignment": "数学或表格对齐语法损坏；从原始 TeX 恢复对应块。",
    "compile.verbatim_corruption": "代码或 verbatim 环境被翻译破坏；从原文恢复保护块后重编译。",
    "quality.untranslated_prose": "普通正文翻译覆盖不足；先排除代码/数据示例，再重新翻译真实英文正文。",
    "compile.resource_exhaustion": "编译资源不足或超时；清理缓存、降低资源压力后重试。",
    "compile.latex_error": "LaTeX 编译错误；优先处理日志中的第一个错误后重编译。",
    "compile.unknown": "未匹配已知编译类型；检查结构化证据和完整日志后扩展分类规则。",
    "quality.pdf_sustained_untranslated": "PDF 多页连续英文正文占优且没有可复用中文 TeX；重新翻译源码，通过 PDF 文本、编译和实体门禁后再发布。",
    "quality.pdf_partial_untranslated": "PDF 存在高置信局部英文正文或证明且没有可复用中文 TeX；按最新 chunk 策略重新翻译并复查命中页。",
    "quality.translation_refusal": "PDF 含模型拒绝翻译或无法协助的回显；丢弃该翻译结果并重新翻译，确认拒绝文本消失后再发布。",
}

#: Priorities of quality diagnoses.
PRIORITIES = {"quality.untranslated_prose": 10, "quality.pdf_partial_untranslated": 20, "quality.pdf_sustained_untranslated": 30, "quality.translation_refusal": 40}


def _row(rule, shown: Column) -> Column:
    category, family, strategy, action = rule[:4]
    return F.struct(
        F.lit(category).alias("category"),
        F.lit(family).alias("family"),
        F.lit(strategy).alias("retry_strategy"),
        F.lit(action).alias("repair_action"),
        F.lit(strategy != "manual_review").alias("retryable"),
        F.substring(F.coalesce(shown, F.lit("")), 1, 500).alias("evidence"),
        F.lit(SUGGESTIONS.get(category)).cast("string").alias("suggestion"),
    )


def ladder(text: Column, rules, otherwise, wide: Column | None = None) -> Column:
    """The struct of the first rule whose patterns match."""
    out = _row(otherwise, F.substring(text, 1, 500))
    for rule in reversed(rules):
        own = wide if wide is not None and rule[0] in BOTH_TEXTS else text
        pattern = "(?i)" + rule[4]
        hit = own.rlike(pattern)
        for more in rule[5:]:
            hit = hit & own.rlike("(?i)" + more)
        # Evidence is looked for line by line, in any case.
        shown = "(?im)" + SHOWN.get(rule[0], rule[4].removeprefix("(?s)").removeprefix("(?-i)"))
        out = F.when(hit, _row(rule, evidence(own, shown))).otherwise(out)
    return out


def classify(phase, log, error) -> Column:
    """Category, family, retry strategy, repair action, retryable, evidence and suggestion of a failure.

    Translation failures are told from the error text, all others from the log. Null texts are empty.
    """
    phase, log, error = (F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in (phase, log, error))
    both = F.concat(error, F.lit("\n"), log)
    return F.when(phase == "translate", ladder(error, TRANSLATE_LADDER, TRANSLATE_ELSE)).otherwise(ladder(log, COMPILE_LADDER, COMPILE_ELSE, both))


def quality_failure(category, shown) -> Column:
    """The fields of a known quality diagnosis with its evidence; null for other categories."""
    category, shown = (F.col(c) if isinstance(c, str) else c for c in (category, shown))
    out = None
    for rule in (*QUALITY, *(r for r in COMPILE_LADDER if r[0] == "quality.untranslated_prose")):
        hit = F.when(category == rule[0], _row(rule, shown))
        out = hit if out is None else hit.otherwise(out)
    return out


def priority(category) -> Column:
    category = F.col(category) if isinstance(category, str) else category
    out = F.lit(0)
    for name, p in PRIORITIES.items():
        out = F.when(category == name, p).otherwise(out)
    return out
