"""Column builders: text helpers, answer extraction and normalization, chat
rendering, loosely-shaped record access and thinking-trace parsing. Every
function returns a Column and runs inside the JVM.
"""
