"""Leftovers of a translation model in a text: requests for input, prefaces, serialised answers, invented passages."""

#: Fixed values, in the order in which they are applied. A quoted string is read without going back, so that long ones don't fill the stack.
ARTIFACTS = (
    r'(?m)^[ \t]*"translation"\s*:\s*"[^"\\]*+(?:\\.[^"\\]*+)*+"\s*,?[ \t]*$',
    r'(?m)^[ \t]*\[\s*"[^"\\]*+(?:\\.[^"\\]*+)*+"(?:\s*,\s*"[^"\\]*+(?:\\.[^"\\]*+)*+")*\s*\][ \t]*$',
    r"(?s)\n\\section\{引言\}\s*\n\s*在过去的几十年中.*?我们希望本工作能够为相关领域提供新的思路和工具。\s*",
    r"(?i)Please provide the section from the English academic paper that you would like me to translate into Chinese\.",
    r"(?i)Please provide[^。\n]*?(?:Chinese|中文)[^。\n]*(?:\.|。)?",
    r"(?i)Please provide the text you would like me to translate\.",
    r"(?i)Please provide the text you want me to translate\.",
    r"(?i)Please provide the English text you want me to translate\.",
    r"(?i)Please provide the English section you want me to translate\.",
    r"(?i)\(?Please provide the section you want translated\.\)?",
    r"(?i)\.?\s*Please provide the section you would like me to translate\.",
    r"(?i)\.?\s*Please provide the English text you want to translate\.",
    r"(?i)\.?\s*Please provide the English academic paper section for translation\.",
    r"(?i)\.?\s*Please provide the English academic paper section you want translated\.",
    r"(?i)\.?\s*Please share the text you want translated\.",
    r"(?i)\.?\s*Please share the section you want to be translated\.",
    r"(?i)If you provide the section you want translated, I can proceed\.",
    r"(?i)If you provide the English academic paper section, I will translate it for you accordingly\.",
    r"(?i)If you have any specific section you want translated, please provide the text\.",
    r"(?i)If you provide the specific text, I can translate it accordingly\.",
    r"(?i)If you provide the English academic paper section, I will translate it accordingly\.",
    r"(?i)as per your instructions\.\s*(?=Please provide|$)",
    r"(?i)Certainly!\s*(?=[一-鿿])",
    r"(?i)Below is the translated text(?: in Chinese)?:?",
    r"(?i)Below is a section from an English academic paper, translated into Chinese(?:\.|:)?",
    r"(?i)Below is the translation of your provided English academic paper section into Chinese\.?",
    r"(?i)Below is the section you provided translated into Chinese\.?",
    r"(?i)Below is the translated Chinese text of the provided English academic paper section(?:\.|:)?",
    r"(?i)Below is the Chinese translation of the provided English academic paper section[^:\n]*(?:\.|:)?",
    r"(?i)Below is the English academic paper section for translation\.\s*",
    r"(?i)Below is an English academic paper section, translated into Chinese[^:\n]*(?:\.|:)?",
    r"(?i)LaTeX commands and equations are kept unchanged\.?",
    r"(?i)All LaTeX commands and equations have been kept intact\.?",
    r"(?i)LaTeX commands have been kept intact as requested\.?",
    "请提供您需要翻译的英文学术论文部分内容。",
    "请提供需要翻译的英文学术论文部分内容。",
    "请提供您需要翻译的英文学术论文部分。",
    "请提供您需要翻译的英文论文部分内容。",
    "请提供需要翻译的英文论文部分内容。",
    "请提供您需要翻译的具体英文内容。",
    "请提供需要翻译的具体英文内容。",
    "请提供需要翻译的具体英文段落内容。",
    "好的，请提供需要翻译的英文部分。",
    "(?:好的|当然|可以)，?请提供您?希望(?:我)?翻译的英文(?:学术论文)?(?:部分|内容|段落)?。?",
    "(?:好的|当然|可以)，?请提供您?需要翻译的英文(?:学术论文)?(?:部分|内容|段落)?。?",
    "请提供您?希望(?:我)?翻译的英文(?:学术论文)?(?:部分|内容|段落)?。?",
    "请提供您?要翻译的英文(?:学术论文)?(?:部分|内容|段落)?。?",
    r"请提供[^。\n]*?(?:论文|文本)[^。\n]*?(?:。|$)",
    "下面是一篇英文学术论文的部分内容，翻译成中文如下。请注意保留所有的latex命令不变：",
    r"抱歉，您提供的文本仅包含[^。\n]*?(?:。|$)",
    r"(?s)机器学习在过去几十年中取得了显著的进展\\cite\{smith2020advances\}。.*?\\cite\{lecun2015deep\}。",
    "(?s)本文提出了一种基于深度学习的新方法，用于图像分类任务。.*?探索其在其他视觉任务中的应用潜力。",
    "(?s)近年来，深度学习在图像识别、自然语言处理等领域取得了显著进展.*?实验部分将在多个公开数据集上验证所提方法的有效性，并与现有主流方法进行对比分析。",
    r"(?s)\\section\{引言\}\s*在过去的几十年里，机器学习已经成为人工智能领域的核心方法之一.*?提出若干有待解决的挑战。",
    r"(?s)\\section\{相关工作\}\s*近年来，深度学习在图像识别、自然语言处理等领域取得了显著进展.*?半监督分类的准确率。",
    r"(?s)在现代计算机科学的发展过程中，机器学习技术得到了广泛的应用。.*?\\cite\{mnih2015human\}。",
    r"(?s)近年来，迁移学习作为一种有效的方法被提出.*?\\cite\{mnih2015human\}。",
    r"(?s)为了解决数据不足的问题，许多研究关注于半监督学习和无监督学习方法\\cite\{lecun2015deep\}。此外，迁移学习.*?仍然是一个挑战。",
)
