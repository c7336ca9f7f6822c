"""No streaming operator is part of the covered query surface.

Every operator of ``colquery.operators`` that is a row-wise filter or
projection also applies unchanged to a streaming DataFrame.
"""
