"""Grammars of the languages that are checked, for ``derivatives.Grammar``.

They describe form, not meaning, and where a language restricts a form by context they take more
rather than less; the token classes are those of ``lexers``.
"""

JSON = """
file = value
value = '{' (member (',' member)*)? '}' | '[' (value (',' value)*)? ']' | STRING | NUMBER | 'true' | 'false' | 'null'
member = STRING ':' value
"""

PYTHON = """
file = (NEWLINE | stmt)*
block = simple_line | NEWLINE INDENT stmt+ DEDENT
simple_line = simple (';' simple)* ';'? NEWLINE
stmt = simple_line | if | while | for | try | with | def | class | match
name = NAME | SOFT
simple = 'pass' | 'break' | 'continue' | 'return' exprs? | 'raise' (test ('from' test)?)? | 'global' name (',' name)*
    | 'nonlocal' name (',' name)* | 'del' exprs | 'assert' test (',' test)? | import | expr_stmt | SOFT name type_params? '=' test
import = 'import' dotted_as (',' dotted_as)* | 'from' ('.' | '...')* dotted? 'import' ('*' | '(' import_as (',' import_as)* ','? ')' | import_as (',' import_as)*)
dotted = name ('.' name)*
dotted_as = dotted ('as' name)?
import_as = name ('as' name)?
expr_stmt = exprs (':' test ('=' (yield | exprs))? | AUGMENTED (yield | exprs) | ('=' (yield | exprs))*) | yield
yield = 'yield' ('from' test | exprs?)
exprs = item (',' item)* ','?
item = '*' chain | named
named = test (':=' test)?
test = chain ('if' chain 'else' test)? | 'lambda' lambda_params? ':' test
chain = operand (binary operand)*
operand = ('not' | '+' | '-' | '~' | 'await')* atom trailer* | ('not')* 'lambda' lambda_params? ':' test
binary = OPERATOR | SLASH | '+' | '-' | '*' | '**' | 'and' | 'or' | 'in' | 'not' 'in' | 'is' 'not'?
atom = name | NUMBER | string+ | '...' | 'None' | 'True' | 'False' | '(' (yield | inside)? ')' | '[' inside? ']' | '{' (inside | dict)? '}'
string = STRING | FSTART (FTEXT | hole)* FEND
hole = '{' (yield | exprs) '='? (BANG name)? (':' (FTEXT | hole)*)? '}'
inside = item (comp+ | (',' item)* ','?)
dict = pair (comp+ | (',' pair)* ','?)
pair = '**' chain | test ':' test
comp = 'async'? 'for' targets 'in' chain ('if' (chain | 'lambda' lambda_params? ':' test) (':=' test)?)*
targets = target (',' target)* ','?
target = '*'? atom trailer*
trailer = '.' name | '(' (argument (',' argument)* ','?)? ')' | '[' subscript (',' subscript)* ','? ']'
argument = '*' test | '**' test | name '=' test | named comp*
subscript = '*' chain | named | test? ':' test? (':' test?)?
lambda_params = lambda_param (',' lambda_param)* ','?
lambda_param = SLASH | '*' name? | '**' name | name ('=' test)?
params = param (',' param)* ','?
param = SLASH | '*' (name (':' item)?)? | '**' name (':' test)? | name (':' test)? ('=' test)?
type_params = '[' type_param (',' type_param)* ','? ']'
type_param = ('*' | '**')? name (':' test)? ('=' item)?
if = 'if' named ':' block ('elif' named ':' block)* ('else' ':' block)?
while = 'while' named ':' block ('else' ':' block)?
for = 'async'? 'for' targets 'in' exprs ':' block ('else' ':' block)?
try = 'try' ':' block ('finally' ':' block | except+ ('else' ':' block)? ('finally' ':' block)?)
except = 'except' '*'? (test ('as' name)?)? ':' block
with = 'async'? 'with' (with_item (',' with_item)* | '(' with_item (',' with_item)* ','? ')') ':' block
with_item = test ('as' target)?
decorator = '@' named NEWLINE
def = decorator* 'async'? 'def' name type_params? '(' params? ')' ('->' exprs)? ':' block
class = decorator* 'class' name type_params? ('(' (argument (',' argument)* ','?)? ')')? ':' block
match = SOFT exprs ':' NEWLINE INDENT case+ DEDENT
case = SOFT patterns ('if' named)? ':' block
patterns = pattern (',' pattern)* ','?
pattern = '*' name | closed (OPERATOR closed)* ('as' name)?
closed = ('-')? NUMBER (('+' | '-') NUMBER)? | string+ | 'None' | 'True' | 'False' | name ('.' name)* ('(' (kwpattern (',' kwpattern)* ','?)? ')')?
    | '(' patterns? ')' | '[' patterns? ']' | '{' (keypattern (',' keypattern)* ','?)? '}'
kwpattern = (name '=')? pattern
keypattern = '**' name | closed ':' pattern
"""

TYPESCRIPT = """
file = stmt*
ident = ID | CONTEXT
anyname = ident | RESERVED | 'this' | 'typeof' | 'void' | 'new' | 'import' | 'export' | 'function' | 'class' | 'extends' | 'in' | 'instanceof' | 'null' | 'const' | 'var' | 'enum'
    | 'if' | 'else' | 'for' | 'while' | 'do' | 'return' | 'throw' | 'try' | 'catch' | 'finally' | 'switch' | 'case' | 'default' | 'break' | 'continue' | 'debugger' | 'delete' | 'super' | 'true' | 'false' | 'with' | 'yield'
    | 'let' | 'type' | 'interface' | 'as' | 'of' | 'async' | 'await' | 'from' | 'is' | 'asserts' | 'satisfies' | 'declare' | 'abstract' | 'namespace' | 'static' | 'readonly' | 'keyof' | 'infer' | 'require' | 'get' | 'set' | 'unique' | 'out'
name = ident | 'let' | 'type' | 'as' | 'of' | 'async' | 'await' | 'from' | 'is' | 'asserts' | 'satisfies' | 'declare' | 'abstract' | 'namespace' | 'static' | 'readonly' | 'keyof' | 'infer' | 'require' | 'get' | 'set' | 'unique' | 'out' | 'interface' | 'yield'
block = '{' stmt* '}'
stmt = block | ';' | vars EOS | func | class | 'if' '(' expr ')' stmt ('else' stmt)? | 'while' '(' expr ')' stmt | 'do' stmt 'while' '(' expr ')' ';'?
    | 'for' 'await'? '(' for_head ')' stmt | 'return' expr? EOS | 'throw' expr EOS | 'break' name? EOS | 'continue' name? EOS | 'debugger' EOS
    | 'try' block ('catch' ('(' bind (':' type)? ')')? block ('finally' block)? | 'finally' block)
    | 'switch' '(' expr ')' '{' (('case' expr | 'default') ':' stmt*)* '}' | name ':' stmt | import | export | interface | alias | enum | namespace
    | 'declare' (declared | ident STRING? (block | EOS)) | leading EOS
declared = vars EOS | func | class | interface | alias | enum | namespace
vars = ('var' | 'let' | 'const') bindings
bindings = binding (',' binding)*
binding = bind '!'? (':' type)? ('=' assign)?
for_head = (vars | expr)? ';' expr? ';' expr? | (('var' | 'let' | 'const') bind | expr) ('of' | 'in') expr
interface = 'interface' name type_params? ('extends' type (',' type)*)? object_type
alias = 'type' name type_params? '=' type EOS
enum = 'const'? 'enum' name '{' (enum_member (',' enum_member)* ','?)? '}'
enum_member = (anyname | STRING) ('=' assign)?
namespace = 'namespace' (name ('.' name)* | STRING) (block | EOS)
import = 'import' STRING with? EOS | 'import' 'type'? import_clause 'from' STRING with? EOS | 'import' 'type'? name '=' ('require' '(' STRING ')' | name ('.' anyname)*) EOS
with = 'with' object
import_clause = name (',' (star_as | specifiers))? | star_as | specifiers
star_as = '*' 'as' name
specifiers = '{' (specifier (',' specifier)* ','?)? '}'
specifier = 'type'? (anyname | STRING) ('as' (anyname | STRING))?
export = 'export' (declared | 'declare' declared | 'default' (func | class | interface | assign EOS) | 'type'? '*' ('as' (anyname | STRING))? 'from' STRING with? EOS
    | 'type'? specifiers ('from' STRING with?)? EOS | '=' expr EOS | 'as' 'namespace' name EOS | import)
func = 'async'? 'function' '*'? name? type_params? '(' params ')' (':' type)? (block | EOS)
expr = assign (',' assign)*
leading = (prefix+ postfix | 'yield' '*'? assign? | plain suffix* INCREMENT?) tail* (',' assign)*
assign = operand tail*
tail = binary operand | '?' assign ':' assign | ('as' | 'satisfies') (type | 'const')
binary = OPERATOR | '<' | '>' ('>' '>'?)? '='? | '=' | '+' | '-' | '*' | '/' | '|' | '&' | 'in' | 'instanceof'
operand = prefix* postfix | 'yield' '*'? assign?
prefix = '!' | '~' | '+' | '-' | INCREMENT | 'typeof' | 'void' | 'delete' | 'await' | 'new' | '<' type '>'
postfix = primary suffix* INCREMENT?
suffix = '.' (anyname | PRIVATE) | '?.' (anyname | PRIVATE) | '?.' type_args? arguments | '?.'? '[' expr ']' | arguments | template | '!' | type_args (arguments | template)?
arguments = '(' (argument (',' argument)* ','?)? ')'
argument = '...'? assign
primary = plain | object | function | class_expr
plain = name | STRING | NUMBER | REGEX | PRIVATE | 'this' | 'super' | 'null' | 'true' | 'false' | template | '(' expr ')' | array | arrow
    | 'import' ('(' assign (',' assign)? ','? ')' | '.' anyname) | 'new' '.' ident | jsx
template = TEMPLATE | THEAD expr (TMIDDLE expr)* TTAIL
array = '[' ','* (element (','+ element)* ','*)? ']'
element = '...'? assign
object = '{' (property (',' property)* ','?)? '}'
property = '...' assign | key ':' assign | name ('=' assign)? | modifier* '*'? key type_params? '(' params ')' (':' type)? block
modifier = 'async' | 'get' | 'set'
key = anyname | STRING | NUMBER | PRIVATE | '[' expr ']'
function = 'async'? 'function' '*'? name? type_params? '(' params ')' (':' type)? block
class_expr = decorator* 'class' class_tail
class = decorator* 'abstract'? 'class' class_tail
class_tail = name? type_params? ('extends' operand)? ('implements' type (',' type)*)? '{' class_member* '}'
decorator = '@' primary suffix*
class_member = ';' | 'static' block | decorator* class_modifier* member_body
class_modifier = 'static' | 'readonly' | 'declare' | 'abstract' | 'async' | 'get' | 'set' | ACCESS | 'override'
member_body = '*'? key ('?' | '!')? type_params? '(' params ')' (':' type)? (block | EOS) | key ('?' | '!')? (':' type)? ('=' assign)? EOS | '[' ident ':' type ']' (':' type)? EOS
arrow = 'async'? type_params? '(' params ')' (':' type)? '=>' (block | assign) | 'async'? name '=>' (block | assign)
params = (param (',' param)* ','?)?
param = decorator* (ACCESS | 'readonly' | 'override')* '...'? (bind | 'this') '?'? (':' type)? ('=' assign)?
bind = name | '{' (bind_property (',' bind_property)* ','?)? '}' | '[' ','* (bind_element (','+ bind_element)* ','*)? ']'
bind_property = '...' name | key ':' bind ('=' assign)? | name ('=' assign)?
bind_element = '...'? bind ('=' assign)?
type = 'abstract'? 'new' type_params? '(' params ')' '=>' type | type_params? '(' params ')' '=>' type | 'asserts' (ident | 'this') ('is' type)? | (ident | 'this') 'is' type
    | union ('extends' union '?' type ':' type)?
union = ('|' | '&')? part (('|' | '&') part)*
part = ('keyof' | 'unique' | 'readonly' | 'infer')* type_primary (('[' type? ']'))* ('extends' type)?
type_primary = name ('.' anyname)* type_args? | STRING | '-'? NUMBER | 'true' | 'false' | 'null' | 'void' | 'this' | template_type | '(' type ')' | object_type
    | '[' (tuple_part (',' tuple_part)* ','?)? ']' | 'typeof' (name | 'this' | 'import' '(' STRING ')') ('.' (anyname | PRIVATE))* type_args? | 'import' '(' STRING ')' ('.' anyname)* type_args?
    | type_params? '(' params ')' '=>' type | 'abstract'? 'new' type_params? '(' params ')' '=>' type
template_type = TEMPLATE | THEAD type (TMIDDLE type)* TTAIL
tuple_part = '...'? (name '?'? ':')? type '?'?
type_args = '<' type (',' type)* ','? '>'
type_params = '<' type_param (',' type_param)* ','? '>'
type_param = ('const' | 'in' | 'out')* name ('extends' type)? ('=' type)?
object_type = '{' (type_member type_end)* '}'
type_end = ',' | EOS
type_member = type_modifier* key '?'? type_params? '(' params ')' (':' type)? | type_modifier* key '?'? (':' type)? | 'new'? type_params? '(' params ')' (':' type)?
    | type_modifier* '[' ident ':' type ']' (':' type)? | (('+' | '-')? 'readonly')? '[' ident 'in' type ('as' type)? ']' (('+' | '-')? '?')? (':' type)?
type_modifier = 'readonly' | 'get' | 'set'
jsx = JOPEN JNAME attribute* JSELF | JOPEN JNAME attribute* JCLOSE child* JEND JNAME JCLOSE | JOPEN JCLOSE child* JEND JCLOSE
attribute = JNAME (JEQUALS (JSTRING | '{' assign '}' | jsx))? | '{' '...' assign '}'
child = JTEXT | jsx | '{' ('...'? expr)? '}'
"""
