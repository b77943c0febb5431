"""Functions of texts that Spark lacks, in the JVM.

Compatibility composition, transliteration to Latin letters and the ASCII form of domain names come with the ICU library
and the JDK that Spark runs on, but have no SQL function, and ICU's transliteration looks at neighbours (Han gets blanks
between syllables, Hangul hyphens, kana digraphs), so a table of characters won't do. Nor has SQL an edit distance that stops once
it is too far, or Jaro's matching. One-method Java functions
are compiled in memory by Janino, which Spark brings for its own code generation, added to the session as a jar and
registered. Text never leaves the JVM, and every executor works on its own rows.
"""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the ICU transform.
TRANSFORM = "Any-Latin; NFD; [:Nonspacing Mark:] Remove; NFC"
_SOURCE = f"""
package rowsieve;

import org.apache.spark.sql.api.java.UDF1;
import org.apache.spark.sql.api.java.UDF2;
import org.apache.spark.sql.api.java.UDF3;
import java.util.HashMap;
import com.ibm.icu.text.Transliterator;

public class Latin implements UDF1 {{
    private static final ThreadLocal TRANSFORMS = new ThreadLocal();

    public Object call(Object text) {{
        Transliterator t = (Transliterator) TRANSFORMS.get();
        if (t == null) {{
            t = Transliterator.getInstance("{TRANSFORM}");
            TRANSFORMS.set(t);
        }}
        return text == null ? null : t.transliterate((String) text);
    }}
}}

class Composed implements UDF1 {{
    public Object call(Object text) {{
        return text == null ? null : java.text.Normalizer.normalize((String) text, java.text.Normalizer.Form.NFKC);
    }}
}}

class Domain implements UDF1 {{
    public Object call(Object text) {{
        try {{
            return text == null ? null : java.net.IDN.toASCII((String) text);
        }} catch (IllegalArgumentException e) {{
            return null;
        }}
    }}
}}

class Edits implements UDF3 {{
    public Object call(Object left, Object right, Object limit) {{
        if (left == null || right == null || limit == null) return null;
        int[] a = ((String) left).codePoints().toArray(), b = ((String) right).codePoints().toArray();
        int most = ((Integer) limit).intValue();
        int[] row = new int[b.length + 1];
        for (int j = 0; j <= b.length; j++) row[j] = j;
        for (int i = 0; i < a.length; i++) {{
            int corner = row[0], least = ++row[0];
            for (int j = 1; j <= b.length; j++) {{
                int changed = a[i] == b[j - 1] ? corner : corner + 1;
                corner = row[j];
                row[j] = Math.min(changed, Math.min(corner, row[j - 1]) + 1);
                least = Math.min(least, row[j]);
            }}
            if (least > most) return Integer.valueOf(-1);
        }}
        return Integer.valueOf(row[b.length]);
    }}
}}

class JaroWinkler implements UDF2 {{
    public Object call(Object left, Object right) {{
        if (left == null || right == null) return Double.valueOf(left == right ? 1.0 : 0.0);
        int[] a = ((String) left).trim().codePoints().toArray(), b = ((String) right).trim().codePoints().toArray();
        if (a.length == 0 || b.length == 0) return Double.valueOf(a.length == b.length ? 1.0 : 0.0);
        boolean same = a.length == b.length;
        for (int i = 0; same && i < a.length; i++) {{
            same = a[i] == b[i] || Character.toUpperCase(a[i]) == Character.toUpperCase(b[i]) || Character.toLowerCase(a[i]) == Character.toLowerCase(b[i]);
        }}
        if (same) return Double.valueOf(1.0);
        int longer = Math.max(a.length, b.length), reach = Math.max(longer / 2 - 1, 0);
        if (Math.abs(a.length - b.length) * 2L > longer) return Double.valueOf(0.0);
        // The free places of each character in b, as chains from its first one. A place behind the window stays behind it.
        HashMap first = new HashMap();
        int[] next = new int[b.length];
        for (int j = b.length - 1; j >= 0; j--) {{
            Object known = first.put(Integer.valueOf(b[j]), Integer.valueOf(j));
            next[j] = known == null ? -1 : ((Integer) known).intValue();
        }}
        int[] partners = new int[a.length];
        boolean[] taken = new boolean[b.length];
        int m = 0;
        for (int i = 0; i < a.length; i++) {{
            Object known = first.get(Integer.valueOf(a[i]));
            if (known == null) continue;
            int j = ((Integer) known).intValue();
            while (j >= 0 && j < i - reach) j = next[j];
            if (j >= 0 && j <= i + reach) {{
                partners[m++] = a[i];
                taken[j] = true;
                j = next[j];
            }}
            first.put(Integer.valueOf(a[i]), Integer.valueOf(j));
        }}
        if (m == 0) return Double.valueOf(0.0);
        int moved = 0, k = 0;
        for (int j = 0; j < b.length; j++) {{
            if (taken[j] && b[j] != partners[k++]) moved++;
        }}
        double jaro = ((double) m / a.length + (double) m / b.length + (m - moved / 2.0) / m) / 3;
        int prefix = 0, end = Math.min(4, Math.min(a.length, b.length));
        while (prefix < end && a[prefix] == b[prefix]) prefix++;
        return Double.valueOf(Math.min(1.0, Math.max(0.0, jaro + prefix * 0.1 * (1 - jaro))));
    }}
}}
"""
_FUNCTIONS = {
    "rowsieve_latin": ("Latin", "string"),
    "rowsieve_composed": ("Composed", "string"),
    "rowsieve_domain": ("Domain", "string"),
    "rowsieve_edits": ("Edits", "int"),
    "rowsieve_jaro_winkler": ("JaroWinkler", "double"),
}
_ASCII = r"\A\p{ASCII}*\z"


def register(spark: SparkSession) -> None:
    """Compile, ship and register the functions. Once for each session."""
    if spark.catalog.functionExists("rowsieve_latin"):
        return
    jvm = spark._jvm
    compiler = jvm.org.codehaus.janino.SimpleCompiler()
    compiler.setParentClassLoader(jvm.Thread.currentThread().getContextClassLoader())
    compiler.cook(_SOURCE.replace("\nclass ", "\npublic class "))
    path = os.path.join(tempfile.mkdtemp(prefix="rowsieve-"), "rowsieve-functions.jar")
    with zipfile.ZipFile(path, "w") as jar:
        for name, code in dict(compiler.getBytecodes()).items():
            jar.writestr(name.replace(".", "/") + ".class", bytes(code))
    spark.sql(f"ADD JAR '{path}'")
    for name, (kind, type_) in _FUNCTIONS.items():
        made = compiler.getClassLoader().loadClass(f"rowsieve.{kind}").getDeclaredConstructor(_none(spark, "Class"))
        spark._jsparkSession.udf().register(name, made.newInstance(_none(spark, "Object")), jvm.org.apache.spark.sql.types.DataType.fromDDL(type_))


def _none(spark: SparkSession, kind: str):
    """An empty Java array, for reflection's variable arguments."""
    return spark._sc._gateway.new_array(getattr(spark._jvm.java.lang, kind), 0)


def _unless_ascii(name: str, text: Column) -> Column:
    """ASCII text is its own form and skips the call."""
    return F.when(text.rlike(_ASCII), text).otherwise(F.call_function(name, text))


def to_latin(text: Column) -> Column:
    return _unless_ascii("rowsieve_latin", text)


def composed(text: Column) -> Column:
    """NFKC."""
    return _unless_ascii("rowsieve_composed", text)


def ascii_domain(domain: Column) -> Column:
    """The ASCII form of an internationalized domain name, or null."""
    return _unless_ascii("rowsieve_domain", domain)


def edits(left: Column, right: Column, most: Column) -> Column:
    """The edit distance of two texts, in code points; -1 where each prefix of the right text is further than most from a prefix
    of the left one. Two rows of numbers at a time, and no more of them than needed."""
    return F.call_function("rowsieve_edits", left, right, most)


def jaro_winkler(left: Column, right: Column) -> Column:
    """Jaro's similarity, raised by a common prefix of up to four characters; 0 if one text is twice as long, 1 if they are equal
    but for case and outer blanks. Time is linear in the texts."""
    return F.call_function("rowsieve_jaro_winkler", left, right)
