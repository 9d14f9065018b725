"""Rule tables that results depend on: sinks of the walk and sources of taint.

These are the commonest of them; `read_sinks` reads larger tables from files.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

# Languages of rules as extensions of files.
LANGUAGES = {
    "c": ("c", "h"), "cpp": ("cpp", "cc", "cxx", "hpp", "hxx", "hh"), "objc": ("m", "mm"), "java": ("java",), "kotlin": ("kt", "kts"), "python": ("py",), "ruby": ("rb", "rake"), "go": ("go",),
    "rust": ("rs",), "php": ("php", "phtml", "inc"), "csharp": ("cs", "csx"), "javascript": ("js", "jsx", "ts", "tsx"), "CFamilyLangs": ("c", "h", "cpp", "cc", "cxx", "hpp", "hxx", "hh", "m", "mm"),
}

# Sinks by category, as name:severity rank:argument[:languages].  The argument is the dangerous one, from
# 0; `-` is any, `*` reports the call whatever it is given, `f` marks a format.
SINK_TEXT = {
    "Command Injection": """
        system|2|0 popen|2|0 execl|2|1 execlp|2|1 execv|1|0 execvp|1|0 posix_spawn|2|3 posix_spawnp|2|3 popen|2|0 Runtime.exec|2|0 ProcessBuilder.start|2|0 Process.Start|2|0
        std::system|2|0 boost::process::system|2|0 exec|2|0 ProcessBuilder|2|0 start|1|0 os.system|2|0|python os.popen|2|0|python os.spawnl|2|0|python os.spawnv|2|0|python
        subprocess.call|2|0|python subprocess.Popen|2|0|python subprocess.run|2|0|python subprocess.check_call|2|0|python subprocess.check_output|2|0|python
        subprocess.getoutput|2|0|python commands.getoutput|2|0|python commands.getstatusoutput|2|0|python os.popen2|2|0|python os.popen3|2|0|python popen2.popen2|2|0|python
        exec|2|0|python+ruby os.execl|2|1|python os.execv|2|1|python os.spawnvp|2|2|python os.spawnve|2|2|python subprocess.getstatusoutput|2|0|python IO.popen|2|0|ruby
        Open3.capture|2|0|ruby Open3.capture2|2|0|ruby Open3.capture3|2|0|ruby Open3.popen|2|0|ruby spawn|2|0|ruby system|2|0|ruby Open3.capture2e|2|0|ruby Open3.pipeline|2|0|ruby
        Open3.popen2|2|0|ruby Process.exec|2|0|ruby exec.Command|2|-|go exec.CommandContext|2|2|go os.StartProcess|2|0|go syscall.Exec|2|0|go syscall.StartProcess|2|0|go
        syscall.ForkExec|2|0|go Command.new|2|0|rust std.process.Command|2|0|rust tokio.process.Command|2|0|rust arg|2|0|rust args|2|0|rust std.process.Command.new|2|0|rust
        system|2|0|objc popen|2|0|objc execvp|2|0|objc posix_spawn|2|1|objc Runtime.getRuntime|2|0|kotlin ProcessBuilder.start|2|0|kotlin ProcessBuilder|2|0|kotlin start|1|0|kotlin
        exec|2|0|kotlin ProcessBuilder.command|2|0|kotlin command|2|0|kotlin system|2|0|php proc_open|2|0|php shell_exec|2|0|php passthru|2|0|php popen|2|0|php pcntl_exec|2|0|php
        exec|2|0|php
    """,
    "Code Injection": """
        eval|2|0|python compile|2|0|python instance_eval|2|0|ruby class_eval|2|0|ruby module_eval|2|0|ruby send|1|0|ruby objc_msgSend|2|*0|objc NSClassFromString|2|0|objc
        NSSelectorFromString|2|0|objc dlopen|2|*0|objc dlsym|2|*0|objc predicateWithFormat|2|*0|objc valueForKeyPath|2|*0|objc eval|3|0|php assert|2|0|php preg_replace|2|2|php
        create_function|2|1|php
    """,
    "Insecure Deserialization": """
        cJSON_Parse|2|0 jansson_load|2|0 YAML_Load|3|*0 ObjectInputStream|3|*0 BinaryFormatter.Deserialize|3|*0 XmlSerializer.Deserialize|2|0 Deserialize|3|*0 XmlSerializer|2|0
        readObject|3|0 pickle.loads|3|0|python pickle.load|3|0|python joblib.load|3|0|python shelve.open|3|0|python yaml.load|2|0|python cPickle.loads|3|0|python
        marshal.load|3|0|python numpy.load|1|0|python torch.load|3|0|python YAML.load|3|0|ruby Marshal.load|3|0|ruby load|2|0|ruby YAML.unsafe_load|3|0|ruby YAML.load_file|3|0|ruby
        JSON.load|2|0|ruby Oj.load|2|0|ruby Psych.load|3|0|ruby gob.NewDecoder|2|*0|go serde_yaml.from_str|2|0|rust bincode.deserialize|2|0|rust ron.from_str|2|0|rust
        NSKeyedUnarchiver|2|*0|objc NSPropertyListSerialization|2|*0|objc enableDefaultTyping|3|*-|java NSKeyedArchiver|2|*0|objc readObject|3|*0|kotlin
        ObjectInputStream|3|0|kotlin XMLDecoder|3|0|kotlin enableDefaultTyping|3|*0|kotlin unserialize|3|0|php
    """,
    "Buffer Overflow": """
        strcpy|2|0 strcat|2|0 gets|3|*0|c+cpp+objc wcscpy|2|0 memcpy|1|2 memmove|1|2 strncpy|0|0 strncat|0|2 bzero|0|0 scanf|2|- sscanf|1|- fscanf|1|- strncpy_s|0|0 strncat_s|0|2
        strcpy_s|0|0 strcat_s|0|0 memcpy_s|1|3 memmove_s|1|3 gets_s|0|1 std::string::append|0|0 strcpy|2|0|objc strcat|2|0|objc wcscpy|2|0|objc
    """,
    "Format String": """
        printf|1|0f|CFamilyLangs fprintf|1|1f|CFamilyLangs vsnprintf|1|2f|CFamilyLangs syslog|1|1f|CFamilyLangs vprintf|1|0f|CFamilyLangs dprintf|1|1f vdprintf|1|1f syslog|1|1f
        warn|0|0f|CFamilyLangs error|0|0f|CFamilyLangs stringWithFormat|2|0|objc CFStringAppendFormat|2|*2|objc
    """,
    "Path Traversal (File Inclusion)": """
        include|2|0|php include_once|2|0|php require|2|0|php require_once|2|0|php
    """,
    "Buffer Overflow / Format String": """
        sprintf|2|1f|CFamilyLangs vsprintf|2|1f|CFamilyLangs
    """,
}

# Calls and names whose value an attacker may have chosen, by language.
SOURCE_TEXT = {
    "c": """
        getenv gets getwd getpass fgets fgetc read recv recvfrom fread scanf fscanf sscanf strdup strndup getopt getopt_long realpath readlink asprintf vasprintf dlsym strchr
        strrchr strstr strtok strtok_r index rindex memdup_user memdup_user_nul kstrdup kasprintf kstrndup ksize simple_strtoul simple_strtol
    """,
    "python": """
        getenv getpass input raw_input sys.argv os.environ request request.args request.form request.json request.values read readline readlines recv stdin environ urllib.request
        urlopen parse_qs get_argument get_arguments get_query_argument get_query_arguments get_body_argument get_body_arguments get_json get_body_json get_cookie get_secure_cookie
    """,
    "go": """
        os.Getenv os.LookupEnv os.Getenvs os.ReadFile os.Open os.OpenFile os.ReadDir os.Readlink ioutil.ReadFile ioutil.ReadDir ioutil.ReadAll io.ReadAll io.ReadString bufio.Scanner
        bufio.NewScanner scanner.Text scanner.Bytes fmt.Scan fmt.Scanln fmt.Scanf json.Unmarshal xml.Unmarshal yaml.Unmarshal Get FormValue PostFormValue PathValue QueryValue Query
        Form Header URL Cookie Cookies Body Referer
    """,
    "php": """
        _GET _POST _REQUEST _COOKIE _FILES _SERVER _ENV getenv file_get_contents file fgets fgetc readfile readline fread parse_str parse_url getallheaders get_headers
        stream_get_contents php_input STDIN argv argc
    """,
    "ruby": """
        gets readline readlines getc read recv STDIN ARGV ENV request params cookies
    """,
    "rust": """
        std.env.var std.env.args std.env.vars env.var env.args std.io.stdin read_line read_to_string stdin env get_input std.fs.read fs.read std::env::var std::env::args
        std::env::vars env::var env::args std::io::stdin std::fs::read fs::read
    """,
}


def sinks() -> list[tuple]:
    """(key, category, severity, argument, extensions) of the table above; argument -1: any, -2: the call itself."""
    out = []
    for category, text in SINK_TEXT.items():
        for entry in text.split():
            name, severity, argument, *langs = entry.split("|")
            place = argument.strip("f") or "-"
            arg = -2 if place.startswith("*") else -1 if place == "-" else int(place)
            exts = tuple(x for lang in langs[0].split("+") for x in LANGUAGES.get(lang, ())) if langs else None
            out.append((name, category, int(severity), arg, exts))
    return out


def sources() -> list[str]:
    """The sources of all languages, each once; names of PHP's request arrays with their sign."""
    names = [f"${x}" if lang == "php" and x[0] == "_" else x for lang, text in SOURCE_TEXT.items() for x in text.split()]
    return list(dict.fromkeys(names))


def read_sinks(spark: SparkSession, path: str) -> list[tuple]:
    """The same from a CSV file with a header key,category,severity,argument,languages (languages joined by +; empty: all).

    A rule table is made by hand and is small: it goes to the driver and into
    every task.
    """
    rows = spark.read.option("header", True).schema("key string, category string, severity int, argument int, languages string").csv(path).collect()
    return [(r["key"], r["category"], r["severity"], r["argument"], tuple(x for lang in r["languages"].split("+") for x in LANGUAGES.get(lang, (lang,))) if r["languages"] else None) for r in rows]
