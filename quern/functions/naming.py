"""Instruction texts for functions, classes and files that carry no documentation."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from quern.functions.text import col, path_stem

# Name prefixes and the verb that stands for each.  The first match wins.
VERB_BY_PREFIX = {
    "get": "获取",
    "set": "设置",
    "is_": "判断是否为",
    "has_": "检查是否包含",
    "calc": "计算",
    "find": "查找",
    "parse": "解析",
    "validate": "验证",
    "generate": "生成",
    "create": "创建",
    "init": "初始化",
    "clean": "清理",
    "process": "处理",
    "load": "加载",
    "save": "保存",
    "read": "读取",
    "write": "写入",
    "open": "打开",
    "close": "关闭",
    "start": "启动",
    "stop": "停止",
    "run": "运行",
    "test": "测试",
}

LISTED_METHODS = 5


def spaced(name: Column) -> Column:
    return F.replace(name, F.lit("_"), F.lit(" "))


def function_instruction(name: Column | str, args: Column | str) -> Column:
    name, args = col(name), col(args)
    listed = F.concat_ws(", ", args)
    tail = F.when(F.size(args) > 0, F.concat(F.lit("，参数为 "), listed)).otherwise("")

    chain = None
    for prefix, verb in VERB_BY_PREFIX.items():
        # A name that is nothing but its prefix keeps the whole name.
        subject = F.when(name == prefix, name).otherwise(F.substr(name, F.lit(len(prefix) + 1)))
        text = F.concat(F.lit(verb + " "), spaced(subject), tail)
        hit = F.startswith(name, F.lit(prefix))
        chain = F.when(hit, text) if chain is None else chain.when(hit, text)
    return chain.otherwise(F.concat(
        F.lit("实现函数 "), spaced(name),
        F.when(F.size(args) > 0, F.concat(F.lit("，接收参数 "), listed)).otherwise("，无需参数"),
    ))


def class_instruction(name: Column | str, methods: Column | str) -> Column:
    name, methods = col(name), col(methods)
    count = F.size(methods)
    more = F.when(
        count > LISTED_METHODS, F.concat(F.lit(" 等 "), count.cast("string"), F.lit(" 个方法"))
    ).otherwise("")
    listed = F.concat(
        F.lit("，包含方法 "), F.concat_ws("、", F.slice(methods, 1, LISTED_METHODS)), more
    )
    return F.concat(F.lit("定义类 "), spaced(name), F.when(count > 0, listed).otherwise(""))


def file_instruction(path: Column | str) -> Column:
    return F.concat(F.lit("实现 "), spaced(path_stem(path)), F.lit(" 模块的完整功能"))
